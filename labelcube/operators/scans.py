"""cumsum, cumprod and diff: windows along a dimension's positions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import number
from ..model import Cube, Group, key
from ..plans.specs import Slice
from ..plans.steps import Scan
from .selection import positions
from .windowed import in_blocks

#: Positions of a block, where a dimension alone would put all its cells on one task.
BLOCK = 65536


def run(cube: Cube, step: Scan) -> Cube:
    dims = [d for d in cube.dims if d in step.dims.among(frozenset(cube.dims))]
    if missing := step.dims.names - set(cube.dims):
        raise ValueError(f"no dimension is called {sorted(map(str, missing))}")
    if step.name == "diff":
        n = step.args[1] if len(step.args) > 1 else step.kwargs.get("n", 1)
        label = step.args[2] if len(step.args) > 2 else step.kwargs.get("label", "upper")
        return diff(cube, dims[0], n, label)
    for d in dims:
        cube = replace(cube, groups=tuple(_cumulate(cube, g, d, step.name) if d in g.dims else g for g in cube.groups))
    return cube


def _cumulate(cube: Cube, g: Group, dim: str, op: str) -> Group:
    """Missing cells count as nothing, and get the running value too. Along its one dimension, blocks are added up first."""
    own = [v for v in g.vars if v not in cube.coords]
    if not own:
        return g
    g = cube.densify(g)
    total = (lambda c: F.sum(c)) if op == "cumsum" else (lambda c: F.product(c.cast("double")))
    zero = {v: F.lit(0).cast("double" if isinstance(g.type_of(v), (T.DoubleType, T.FloatType)) else "long") if op == "cumsum" else F.lit(1.0) for v in own}
    value = {v: F.coalesce(number(F.col(f"`{v}`"), g.type_of(v)), zero[v]) for v in own}
    k, others = f"`{key(dim)}`", [f"`{x}`" for x in g.keys([dim])]
    if others:
        w = Window.partitionBy(*others).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
        return g.select({v: total(value[v]).over(w) if v in own else F.col(f"`{v}`") for v in g.vars})
    block = F.floor(F.col(k) / BLOCK)
    sums = g.df.groupBy(block.alias("@block")).agg(*[total(value[v]).alias(v) for v in own])
    earlier = Window.orderBy("@block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65536 positions
    sums = sums.select("@block", *[F.coalesce(total(F.col(f"`{v}`")).over(earlier), zero[v]).alias(f"@{v}") for v in own])
    w = Window.partitionBy("@block").orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    df = g.df.withColumn("@block", block).join(sums, "@block")
    joined = {v: total(value[v]).over(w) + F.col(f"`@{v}`") if op == "cumsum" else total(value[v]).over(w) * F.col(f"`@{v}`") for v in own}
    return replace(g, df=df.select(k, *(joined[v].alias(v) if v in own else F.col(f"`{v}`") for v in g.vars)))


def diff(cube: Cube, dim: str, n: int = 1, label: str = "upper") -> Cube:
    """n times the step from the cell before. The first n positions go, or the last for label='lower'."""
    groups = []
    for g in cube.groups:
        if dim in g.dims:
            g = cube.densify(g)
            own = [v for v in g.vars if v not in cube.coords]
            others = [f"`{x}`" for x in g.keys([dim])]
            k = f"`{key(dim)}`"
            if not others:  # blocks, with the n cells that a step reaches beyond them
                before, after = (n, 0) if label == "upper" else (0, n)
                g = replace(g, df=in_blocks(g.df, k, max(BLOCK, n), before, after), vars=(*g.vars, "@own", "@block"))
            w = Window.partitionBy(*(others or ["@block"])).orderBy(k)
            for _ in range(n):
                g = g.select({v: number(F.col(f"`{v}`"), g.type_of(v)) - F.lag(number(F.col(f"`{v}`"), g.type_of(v))).over(w) if v in own else F.col(f"`{v}`") for v in g.vars})
            if label == "lower":
                g = g.select({v: F.lead(F.col(f"`{v}`"), n).over(w) if v in own else F.col(f"`{v}`") for v in g.vars})
            if not others:
                g = replace(g, df=g.df.where("`@own` = `@block`").drop("@own", "@block"), vars=tuple(v for v in g.vars if not v.startswith("@")))
        groups.append(g)
    size = cube.axes[dim].n()
    kept = Slice(min(n, size), None) if label == "upper" else Slice(0, max(0, size - n))
    return positions(replace(cube, groups=tuple(groups)), dim, kept)
