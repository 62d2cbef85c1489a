"""Weighted reductions. Weights meet cells by label where both have labels, by position where one has none."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedError
from ..model import Axis, Cube, Group, SmallArray, _python, key, spark_type
from ..plans.steps import Step, WeightedReduce, dims_of
from .selection import positions, labels
from ..plans.specs import Positions

WEIGHT = "@weight"


def run(cube: Cube, step: WeightedReduce) -> Cube:
    weights = step.args[0] if step.args else step.kwargs["weights"]
    return weigh(cube, weights, step.closer.name, step.dims.names if not step.dims.every else None, step.closer)


def aligned(cube: Cube, weights: Any) -> tuple[Cube, DataFrame, tuple[str, ...]]:
    """The cube cut to the labels that the weights have too, and the weights by base position."""
    if isinstance(weights, Cube):
        g = weights.groups[0]
        frame = weights.to_frame(coords=False)
        over, name, own = g.dims, g.vars[0], weights
        for d in over:
            if d in cube.axes and cube.axes[d].table is not None and own.axes[d].table is not None:
                shared = [i for i, x in enumerate(labels(cube.axes[d])) if x in set(labels(own.axes[d]))]
                if len(shared) < cube.axes[d].n():
                    cube = positions(cube, d, Positions(tuple(shared)))
                frame = frame.join(cube.axes[d].frame().select(f"`{d}`", f"`{key(d)}`"), d)
            elif d not in cube.axes:
                cube = replace(cube, axes={**cube.axes, d: own.axes[d]})
                frame = frame.join(own.axes[d].frame().select(f"`{d}`", f"`{key(d)}`"), d)
            else:
                raise UnsupportedError("weights in a cube need labels")
        return cube, frame.select(*(f"`{key(d)}`" for d in over), F.col(f"`{name}`").cast("double").alias(WEIGHT)), over
    if not isinstance(weights, SmallArray):
        raise UnsupportedError("weights are a SmallArray or a cube of one variable")
    places: dict[str, list] = {}
    for d, n in zip(weights.dims, weights.values.shape):
        given = weights.coords.get(d)
        if d not in cube.axes:
            kind = T.StructType([T.StructField(key(d), T.LongType()), *([T.StructField(d, spark_type(np.asarray(given)))] if given else [])])
            rows = [(i, *([_python(np.asarray(given)[i])] if given else [])) for i in range(n)]
            cube = replace(cube, axes={**cube.axes, d: Axis(d, cube.spark.createDataFrame(rows, kind), (d,) if given else (), n)})
            places[d] = list(range(n))
        elif given is not None and d in cube.axes[d].coords:
            own = labels(cube.axes[d])
            at = {x: i for i, x in enumerate(own)}
            given = [_python(x) for x in np.asarray(given)]
            shared = sorted(at[x] for x in given if x in at)
            order = list(cube.axes[d].order())
            places[d] = [order[at[x]] if x in at else None for x in given]
            if len(shared) < len(own):
                cube = positions(cube, d, Positions(tuple(shared)))
        else:
            if cube.axes[d].n() != n:
                raise ValueError(f"weights have {n} positions along {d!r}, the data {cube.axes[d].n()}")
            places[d] = list(cube.axes[d].order())
    rows = [(*p, _python(np.float64(weights.values[i]))) for i in np.ndindex(weights.values.shape) if None not in (p := [places[d][k] for d, k in zip(weights.dims, i)])]
    kind = ", ".join([*(f"`{key(d)}` long" for d in weights.dims), f"`{WEIGHT}` double"])
    return cube, cube.spark.createDataFrame([(*map(int, r[:-1]), r[-1]) for r in rows], kind), weights.dims


def weigh(cube: Cube, weights: Any, op: str, dims: Any, closer: Step) -> Cube:
    cube, table, over = aligned(cube, weights)
    table_side = F.broadcast(table) if isinstance(weights, SmallArray) else table  # a small array has a bounded number of cells
    gone = set(dims) if dims is not None else {*cube.dims, *over}
    groups = []
    for g in cube.groups:
        own = [v for v in g.vars if v not in cube.coords]
        if not own:
            if not gone & set(g.dims):
                groups.append(g)
            continue
        missing = [d for d in over if d not in g.dims]
        wide = (*g.dims, *missing)
        if dims is not None and (lacks := gone - set(wide)):
            raise ValueError(f"{own} have no dimension {sorted(lacks)}")
        shared = [key(d) for d in over if d in g.dims]
        df = g.df.join(table_side, shared) if shared else g.df.crossJoin(table_side) if over else g.df.withColumn(WEIGHT, table.select(WEIGHT).scalar())
        left = [d for d in wide if d not in gone]
        keys = [f"`{key(d)}`" for d in left]
        w = F.col(WEIGHT)
        if op in ("std", "var"):  # the mean first: a single pass by moments loses digits
            means = [F.try_divide(F.sum(F.col(f"`{v}`") * w), F.sum(F.when(F.col(f"`{v}`").isNotNull(), w))).alias(f"@{v}") for v in own]
            mean = df.groupBy(*keys).agg(*means) if keys else df.agg(*means)
            df = df.join(mean, [key(d) for d in left]) if keys else df.crossJoin(F.broadcast(mean))
        made = [_value(op, v, w, closer).alias(v) for v in own]
        out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
        groups.append(Group(out, tuple(left), tuple(own), g.dense or not left))
    return replace(cube, axes={d: a for d, a in cube.axes.items() if d not in gone}, groups=tuple(groups))


def _value(op: str, v: str, w: Column, closer: Step) -> Column:
    x = F.col(f"`{v}`").cast("double")
    held = F.when(x.isNotNull(), w)
    weight = F.sum(held)
    match op:
        case "sum":
            return F.coalesce(F.sum(x * w), F.lit(0.0))
        case "mean":
            return F.try_divide(F.sum(x * w), weight)
        case "var" | "std":
            out = F.try_divide(F.sum(w * (x - F.col(f"`@{v}`")) ** 2), weight)
            return F.sqrt(out) if op == "std" else out
        case "sum_of_weights":
            return F.when(weight != 0, weight)
        case "sum_of_squares":
            return F.coalesce(F.sum(w * (x - F.col(f"`@{v}`")) ** 2), F.lit(0.0))
        case "quantile":
            # Linear interpolation of the weighted distribution, over the sorted (value, weight) pairs of a result cell.
            q = float(closer.args[0] if closer.args else closer.kwargs["q"])
            held = F.array_sort(F.filter(F.collect_list(F.struct(x.alias("x"), w.alias("w"))), lambda p: p["x"].isNotNull() & (p["w"] > 0)))
            return _quantile(held, q)
    raise UnsupportedError(f"weighted(...).{op}")


def _quantile(pairs: Column, q: float) -> Column:
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    squares = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"] * p["w"])
    n = F.try_divide(total * total, squares)  # Kish's effective size
    h = q * (n - 1) + 1
    u = lambda c: F.greatest((h - 1) / n, F.least(h / n, c))
    step = lambda a, p: F.struct((a["c"] + p["w"] / total).alias("c"), (a["s"] + p["x"] * (u(a["c"] + p["w"] / total) * n - u(a["c"]) * n)).alias("s"))
    return F.when(total > 0, F.aggregate(pairs, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), step, lambda a: a["s"]))


def closed(cube: Cube, opener: Step, closer: Step) -> Cube:
    weights = opener.args[0] if opener.args else opener.kwargs["weights"]
    if closer.name == "sum_of_squares":
        base = weigh(cube, weights, "var", _dims(closer), closer)
        total = weigh(cube, weights, "sum_of_weights", _dims(closer), closer)
        merged = {v: t for t in total.groups for v in t.vars}
        groups = []
        for g in base.groups:
            t = merged[g.vars[0]]
            names = t.df.select(*(f"`{k}`" for k in t.keys()), *(F.col(f"`{v}`").alias(f"@{v}") for v in t.vars))
            df = g.df.join(names, g.keys()) if g.dims else g.df.crossJoin(F.broadcast(names))
            groups.append(replace(g, df=df.select(*(f"`{k}`" for k in g.keys()), *(F.coalesce(F.col(f"`{v}`") * F.col(f"`@{v}`"), F.lit(0.0)).alias(v) for v in g.vars))))
        return replace(base, groups=tuple(groups))
    return weigh(cube, weights, closer.name, _dims(closer), closer)


def _dims(closer: Step) -> Any:
    at = 1 if closer.name == "quantile" else 0
    dims = dims_of(closer.args[at] if len(closer.args) > at else closer.kwargs.get("dim"))
    return None if dims.every else dims.names
