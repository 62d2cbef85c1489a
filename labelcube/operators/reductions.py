"""Reductions over dimensions: one aggregation for each set of variables that shares its dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from functools import reduce as fold
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import IDENTITY, aggregate, alone
from ..model import Axis, Cube, Group, key
from ..plans.steps import Reduce

#: Functions that have a reduction of their own.
_KNOWN = {np.mean: "mean", np.sum: "sum", np.max: "max", np.min: "min", np.std: "std", np.var: "var", np.prod: "prod", np.median: "median",
          np.nanmean: "mean", np.nansum: "sum", np.nanmax: "max", np.nanmin: "min", np.nanstd: "std", np.nanvar: "var", np.nanmedian: "median",
          sum: "sum", max: "max", min: "min", len: "count"}


def options(step: Any) -> dict[str, Any]:
    return {k: v for k, v in step.kwargs.items() if k in ("ddof", "skipna", "min_count") and v is not None}


def run(cube: Cube, step: Reduce) -> Cube:
    gone = step.dims.among(frozenset(cube.dims))
    if missing := gone - set(cube.dims):
        raise ValueError(f"no dimension is called {sorted(map(str, missing))}; there are {list(cube.dims)}")
    op: Any = step.name
    if op == "reduce":
        func = step.args[0] if step.args else step.kwargs["func"]
        op = _KNOWN.get(func, func)
    return reduced(cube, op, gone, step.keepdims, **options(step))


def reduced(cube: Cube, op: Any, gone: Iterable[str], keepdims: bool = False, **how: Any) -> Cube:
    gone = set(gone)
    axes = {d: a.known() if d in gone and (op == "any" or how.get("skipna") is False) else a for d, a in cube.axes.items()}
    if op in ("min", "max") and any(axes[d].size == 0 for d in gone):
        raise ValueError(f"{op} of no cells has no value")
    groups = []
    for g in cube.groups:
        if gone & set(g.dims) and (left := [v for v in g.vars if v not in cube.coords]):
            groups.append(over(replace(cube, axes=axes), replace(g, vars=tuple(left)), op, gone & set(g.dims), **how))
        elif not gone & set(g.dims):
            # Over none of its dimensions a variable is reduced all the same, cell by cell; coordinates aren't touched.
            if callable(op):
                groups.append(g)
                continue
            own = {v: F.col(f"`{v}`") if v in cube.coords else alone(op, F.col(f"`{v}`"), g.type_of(v)).alias(v) for v in g.vars}
            full = cube.densify(g) if op in IDENTITY and any(v not in cube.coords for v in g.vars) else g
            groups.append(full.select(own))
    if not keepdims:
        return replace(cube, axes={d: a for d, a in axes.items() if d not in gone}, groups=tuple(groups))
    kept = {d: Axis(d, None, (), 1) if d in gone else a for d, a in axes.items()}
    before = {v: g.dims for g in cube.groups for v in g.vars}
    wide = []
    for g in groups:
        dims = before[g.vars[0]]
        df = g.df.select(*(F.lit(0).cast("long").alias(key(d)) if d in gone else f"`{key(d)}`" for d in dims), *(f"`{v}`" for v in g.vars))
        wide.append(replace(g, df=df, dims=dims))
    return replace(cube, axes=kept, groups=tuple(wide))


def over(cube: Cube, g: Group, op: Any, gone: set[str], **how: Any) -> Group:
    """One group over some of its dimensions."""
    left = tuple(d for d in g.dims if d not in gone)
    if callable(op):
        return _by_function(cube, g, op, gone, left)
    cells = F.lit(fold(lambda a, d: a * cube.axes[d].size, gone, 1)) if all(cube.axes[d].size is not None for d in gone) else None
    made = [aggregate(op, F.col(f"`{v}`"), g.type_of(v), cells, **how).alias(v) for v in g.vars]
    df = g.df.groupBy(*(f"`{key(d)}`" for d in left)).agg(*made) if left else g.df.agg(*made)
    out = Group(df, left, g.vars, g.dense or not left)
    return filled(cube, out, op, **how) if op in IDENTITY and not (how.get("min_count") or how.get("skipna") is False) else out


def filled(cube: Cube, g: Group, op: str, **how: Any) -> Group:
    """Cells whose every input was missing get the value that the reduction has for none; any of missing cells is true."""
    if g.dense:
        return g
    none = True if op == "any" else IDENTITY[op]
    full = cube.densify(g)
    return full.select({v: F.coalesce(F.col(f"`{v}`"), F.lit(none).cast(g.df.schema[v].dataType)) for v in g.vars})


def by_cells(g: Group, func: Callable, gone: set[str], left: tuple[str, ...]) -> Group:
    """A function over the cells of a dense set."""
    return _by_function(None, g, func, gone, left)


def by_function(cube: Cube, func: Callable, gone: set[str]) -> Cube:
    """The function over the dimensions that go, for each variable that has one of them."""
    groups = []
    for g in cube.groups:
        own = set(g.dims) & gone
        data = replace(g, df=g.df.select(*(f"`{k}`" for k in g.keys()), *(f"`{v}`" for v in g.vars if v not in cube.coords)), vars=tuple(v for v in g.vars if v not in cube.coords))
        if not own:
            groups.append(g)
        elif data.vars:
            groups.append(_by_function(cube, data, func, own, tuple(d for d in g.dims if d not in own)))
    return replace(cube, axes={d: a for d, a in cube.axes.items() if d not in gone}, groups=tuple(groups))


def _by_function(cube: Cube, g: Group, func: Callable, gone: set[str], left: tuple[str, ...]) -> Group:
    """A function of a numpy array and an axis, applied to the cells of each result cell at once."""
    out = T.StructType([*(T.StructField(key(d), T.LongType()) for d in left), *(T.StructField(v, T.DoubleType()) for v in g.vars)])
    keys, names, order = [key(d) for d in left], list(g.vars), [key(d) for d in sorted(gone)]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        row: Mapping[str, Any] = {k: pdf[k].iloc[0] for k in keys}
        made = {}
        for v in names:
            values = pdf[v].to_numpy(float, na_value=np.nan)
            try:
                made[v] = float(func(values, axis=0))
            except TypeError:
                made[v] = float(func(values))
        return pd.DataFrame([{**row, **{v: None if x != x else x for v, x in made.items()}}])

    source = g if g.dense else cube.densify(g)
    df = source.df if keys else source.df.withColumn("@all", F.lit(0))
    return Group(df.groupBy(*(f"`{k}`" for k in keys or ["@all"])).applyInPandas(apply, out), left, g.vars, source.dense)
