"""Rolling and coarsened reductions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, number, windowed
from ..model import Axis, Cube, Group, key
from ..plans.steps import WindowedReduce
from .reductions import by_cells, filled, options
from .selection import positions
from ..plans.specs import Slice

#: Positions of a block, where the rolled dimension is a variable's only one.
BLOCK = 65536


def run(cube: Cube, step: WindowedReduce) -> Cube:
    for d in step.window:
        if d not in cube.axes:
            raise ValueError(f"no dimension is called {d!r}")
    if step.name == "coarsen":
        return coarsen(cube, step.closer.name, step.window, step.kwargs, options(step.closer))
    return rolling(cube, step.closer.name, step.window, step.kwargs.get("center", False), step.kwargs.get("min_periods"), options(step.closer).get("ddof", 0))


def in_place(cube: Cube, dim: str) -> Cube:
    """The cube with the dimension's keys equal to its current positions."""
    axis = cube.axes[dim]
    if axis.at is None:
        return cube
    k, place = key(dim), axis.place()
    if place is not None:
        moved = lambda df: df.withColumn(k, place)
    else:
        places = cube.spark.createDataFrame([(int(b), i) for i, b in enumerate(axis.at)], f"`{k}` long, `{k}+` long")
        moved = lambda df: df.join(F.broadcast(places), k).drop(k).withColumnRenamed(f"{k}+", k)  # noqa: E731  the list lies on the driver
    groups = tuple(replace(g, df=moved(g.df)) if dim in g.dims else g for g in cube.groups)
    own = Axis(dim, moved(axis.frame()) if axis.table is not None else None, axis.coords, len(axis.at))
    return replace(cube, axes={**cube.axes, dim: own}, groups=groups)


def in_blocks(df: DataFrame, k: str, length: int, before: int, after: int) -> DataFrame:
    """Blocks of one dimension's positions, each with the cells before and after it that its windows reach: @own is a cell's block, @block the one it is sent to."""
    near = F.sequence(F.greatest(F.floor((F.col(k) - after) / length), F.lit(0)), F.floor((F.col(k) + before) / length))
    return df.withColumn("@own", F.floor(F.col(k) / length)).withColumn("@block", F.explode(near))


def rolling(cube: Cube, op: str, window: Mapping[str, int], center: Any = False, min_periods: int | None = None, ddof: int = 0) -> Cube:
    """Each cell over the window that ends on it, or around it. Absent cells count as missing: frames are of positions, not rows."""
    for d in window:
        cube = in_place(cube, d)
    centred = dict(center) if isinstance(center, Mapping) else dict.fromkeys(window, bool(center))
    before = {d: w // 2 if centred.get(d) else w - 1 for d, w in window.items()}
    least = 1
    for w in window.values():
        least *= w
    least = least if min_periods is None else min_periods
    groups = []
    for g in cube.groups:
        dims = [d for d in window if d in g.dims]
        own = [v for v in g.vars if v not in cube.coords]
        if not dims or not own:
            groups.append(g)
            continue
        if least < _product(window, dims) or op == "count":
            g = cube.densify(g)
        groups.append(_one(cube, g, dims[0], op, window[dims[0]], before[dims[0]], least, ddof) if len(dims) == 1 else _several(cube, g, dims, op, window, before, least, ddof))
    return replace(cube, groups=tuple(groups))


def _product(window: Mapping[str, int], dims: list[str]) -> int:
    n = 1
    for d in dims:
        n *= window[d]
    return n


def _one(cube: Cube, g: Group, dim: str, op: str, size: int, before: int, least: int, ddof: int) -> Group:
    k, others = f"`{key(dim)}`", [f"`{x}`" for x in g.keys([dim])]
    value = lambda w: {v: F.col(f"`{v}`") if v in cube.coords else windowed(op, F.col(f"`{v}`"), g.type_of(v), w, least, ddof) for v in g.vars}
    if others:
        return g.select(value(Window.partitionBy(*others).orderBy(k).rangeBetween(-before, size - 1 - before)))
    wide = in_blocks(g.df, k, max(BLOCK, size), before, size - 1 - before)
    w = Window.partitionBy("@block").orderBy(k).rangeBetween(-before, size - 1 - before)
    df = wide.select(k, "@own", "@block", *(c.alias(v) for v, c in value(w).items())).where("`@own` = `@block`").drop("@own", "@block")
    return replace(g, df=df)


def cumulative(cube: Cube, op: str, dim: str, least: int, ddof: int = 0) -> Cube:
    """Each cell over all up to it. Along a variable's one dimension, blocks are reduced first, and what they give is carried on."""
    cube, n = in_place(cube, dim), cube.axes[dim].n()
    groups = []
    for g in cube.groups:
        own = [v for v in g.vars if v not in cube.coords]
        if dim not in g.dims or not own:
            groups.append(g)
            continue
        g = cube.densify(g)
        groups.append(_carried(cube, g, dim, op, least) if len(g.dims) == 1 and op in _CARRIED else _one(cube, g, dim, op, n, n - 1, least, ddof))
    return replace(cube, groups=tuple(groups))


#: How what blocks give is joined: by adding, multiplying, or taking the least or greatest.
_CARRIED = {"sum": "sum", "count": "sum", "mean": "sum", "prod": "prod", "min": "min", "max": "max"}


def _carried(cube: Cube, g: Group, dim: str, op: str, least: int) -> Group:
    k, own = f"`{key(dim)}`", [v for v in g.vars if v not in cube.coords]
    reduce_ = {"sum": F.sum, "prod": lambda c: F.product(c.cast("double")), "min": F.min, "max": F.max}[_CARRIED[op]]
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "prod": lambda a, b: F.coalesce(a * b, a, b), "min": F.least, "max": F.greatest}[_CARRIED[op]]
    value = {v: number(F.col(f"`{v}`"), g.type_of(v)) for v in own}
    block = F.floor(F.col(k) / BLOCK)
    parts = [x for v in own for x in (reduce_(value[v]).alias(f"@{v}"), F.count(F.col(f"`{v}`")).alias(f"#{v}"))]
    earlier = Window.orderBy("@block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65536 positions
    whole = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}[_CARRIED[op]]
    sums = g.df.groupBy(block.alias("@block")).agg(*parts)
    sums = sums.select("@block", *[x for v in own for x in (whole(F.col(f"`@{v}`")).over(earlier).alias(f"@{v}"), F.sum(F.col(f"`#{v}`")).over(earlier).alias(f"#{v}"))])
    w = Window.partitionBy("@block").orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    df = g.df.withColumn("@block", block).join(sums, "@block")

    def made(v: str) -> Column:
        present = F.count(F.col(f"`{v}`")).over(w) + F.coalesce(F.col(f"`#{v}`"), F.lit(0))
        if op == "count":
            return present if least <= 0 else F.when(present >= least, present)
        found = join(reduce_(value[v]).over(w), F.col(f"`@{v}`"))
        return F.when(present >= least, F.try_divide(found, present) if op == "mean" else found)

    return replace(g, df=df.select(k, *(made(v).alias(v) if v in own else F.col(f"`{v}`") for v in g.vars)))


def _several(cube: Cube, g: Group, dims: list[str], op: str, window: Mapping[str, int], before: Mapping[str, int], least: int, ddof: int) -> Group:
    """Every cell is sent to the windows that hold it, which are added up as any groups are."""
    df = g.df
    for d in dims:
        shift = F.explode(F.sequence(F.lit(-(window[d] - 1 - before[d])), F.lit(before[d])))
        df = df.withColumn("@shift", shift).withColumn(key(d), F.col(f"`{key(d)}`") + F.col("@shift")).drop("@shift")
        df = df.where((F.col(f"`{key(d)}`") >= 0) & (F.col(f"`{key(d)}`") < cube.axes[d].n()))
    own = [v for v in g.vars if v not in cube.coords]
    made = [F.when(F.count(F.col(f"`{v}`")) >= least, aggregate(op, F.col(f"`{v}`"), g.type_of(v), ddof=ddof)).alias(v) for v in own]
    keys = [f"`{x}`" for x in g.keys()]
    return Group(df.groupBy(*keys).agg(*made), g.dims, tuple(own), g.dense)


def coarsen(cube: Cube, op: Any, window: Mapping[str, int], said: Mapping[str, Any], how: dict) -> Cube:
    """Blocks of positions become one; boundary says what becomes of an uneven end, coord_func how labels are joined."""
    boundary, side, coord_func = said.get("boundary", "exact"), said.get("side", "left"), said.get("coord_func", "mean")
    shift: dict[str, int] = {}
    for d, w in window.items():
        n = cube.axes[d].n()
        if n % w and boundary == "exact":
            raise ValueError(f"{d!r} has {n} positions, which windows of {w} don't divide; say boundary='trim' or 'pad'")
        at_right = (side.get(d, "left") if isinstance(side, Mapping) else side) == "right"
        if n % w and boundary == "trim":
            cube = positions(cube, d, Slice(n % w, None) if at_right else Slice(0, n - n % w))
        shift[d] = (-n) % w if boundary == "pad" and at_right else 0
        cube = in_place(cube, d)
    sizes = {d: -(-cube.axes[d].n() // w) for d, w in window.items()}
    place = lambda d: F.floor((F.col(f"`{key(d)}`") + shift[d]) / window[d]).cast("long")
    axes = dict(cube.axes)
    for d in window:
        axis = cube.axes[d]
        table: DataFrame | None = None
        if axis.table is not None and axis.coords:
            frame = axis.frame()
            joined = [_label(F.col(f"`{c}`"), frame.schema[c].dataType.typeName(), coord_func.get(c, "mean") if isinstance(coord_func, Mapping) else coord_func).alias(c) for c in axis.coords]
            table = frame.groupBy(place(d).alias(key(d))).agg(*joined)
        axes[d] = Axis(d, table, axis.coords if table is not None else (), sizes[d])
    out = replace(cube, axes=axes)
    groups = []
    for g in cube.groups:
        dims = [d for d in window if d in g.dims]
        own = [v for v in g.vars if v not in cube.coords]
        if not dims or not own:
            if not dims:
                groups.append(g)
            continue
        if callable(op):
            inner = [F.pmod(F.col(f"`{key(d)}`") + shift[d], F.lit(window[d])).alias(key(f"{d}+window")) for d in dims]
            keys = [place(d).alias(key(d)) if d in dims else F.col(f"`{key(d)}`") for d in g.dims]
            cells = Group(cube.densify(g).df.select(*keys, *inner, *(f"`{v}`" for v in own)), (*g.dims, *(f"{d}+window" for d in dims)), tuple(own), True)
            groups.append(by_cells(cells, op, {f"{d}+window" for d in dims}, g.dims))
            continue
        full = cube.densify(g) if op in ("any", "all") else g
        keys = [place(d).alias(key(d)) if d in dims else F.col(f"`{key(d)}`") for d in g.dims]
        cells = F.lit(_product(window, dims)) if boundary == "pad" or op == "any" else None
        made = [aggregate(op, F.col(f"`{v}`"), g.type_of(v), cells if op == "any" else None, **how).alias(v) for v in own]
        new = Group(full.df.groupBy(*keys).agg(*made), g.dims, tuple(own), g.dense)
        groups.append(filled(out, new, op) if op in ("sum", "prod", "count", "all", "any") else new)
    return replace(out, groups=tuple(groups))


def _label(c: Any, kind: str, how: str) -> Any:
    if how == "mean" and kind.startswith("timestamp"):
        whole = F.unix_micros(c.cast("timestamp"))
        return F.timestamp_micros(F.floor(F.avg(whole)).cast("long")).cast("timestamp_ntz")
    if how == "mean" and kind == "string":
        how = "min"
    return {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median}[how](c)
