"""Calls that no rule knows. They run where they stand."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..model import Cube, Group, SmallArray, key
from ..plans.steps import OPENERS, Elementwise, Opaque, Step, step_of
from . import grouped, scans, selection, weighted, windowed
from .elementwise import run as elementwise


def run(cube: Cube, step: Opaque, following: Step | None) -> tuple[Cube, int]:
    """The cube after the step, and how many steps that took: an opener takes its closer along."""
    if step.name in OPENERS:
        if following is None:
            raise UnsupportedError(f"{step.name}(...) alone is half an operation; say what to do with it")
        return _closed(cube, step, following), 2
    call = _CALLS.get(step.name)
    if call is None:
        raise UnsupportedError(f"{step.name}() isn't known; pipe(function of a cube) runs anything")
    return call(cube, *step.args, **step.kwargs), 1


def _closed(cube: Cube, opener: Step, closer: Step) -> Cube:
    if opener.name in ("groupby", "groupby_bins", "resample"):
        return grouped.closed(cube, opener, closer)
    if opener.name == "weighted":
        return weighted.closed(cube, opener, closer)
    if opener.name == "cumulative":
        dims = opener.args[0] if opener.args else opener.kwargs.get("dim")
        dims = [dims] if isinstance(dims, str) else list(dims)
        least = opener.kwargs.get("min_periods") or 1
        for d in dims:
            cube = windowed.cumulative(cube, closer.name, d, least, closer.kwargs.get("ddof", 0))
        return cube
    if opener.name == "rolling":
        from ..plans.pairing import window_of

        window = window_of(opener) or {}
        if closer.name == "construct" and len(window) == 1:
            return construct(cube, *next(iter(window.items())), opener.kwargs, closer)
        if closer.name == "reduce":
            return windowed_function(cube, window, opener.kwargs, closer)
        if closer.name in ("all", "any"):
            (d, _), = window.items()
            flags = replace(cube, groups=tuple(g.select({v: F.col(f"`{v}`") if v in cube.coords else F.coalesce(F.col(f"`{v}`").cast("boolean"), F.lit(True)).cast("long") for v in g.vars}) if d in g.dims else g for g in map(cube.densify, cube.groups)))
            out = windowed.rolling(flags, "min" if closer.name == "all" else "max", window, opener.kwargs.get("center", False), opener.kwargs.get("min_periods"))
            return replace(out, groups=tuple(g.select({v: F.col(f"`{v}`") if v in out.coords else F.col(f"`{v}`").cast("boolean") for v in g.vars}) if d in g.dims else g for g in out.groups))
    if opener.name == "rolling_exp" and closer.name in ("mean", "sum"):
        (d, size), = {k: v for k, v in {**dict(opener.args[0] if opener.args else {}), **opener.kwargs}.items() if k in cube.axes}.items()
        return exponential(cube, d, float(size), opener.kwargs.get("window_type", "span"), closer.name)
    if opener.name == "coarsen" and closer.name == "reduce":
        from ..plans.pairing import window_of

        return windowed.coarsen(cube, closer.args[0] if closer.args else closer.kwargs["func"], window_of(opener) or {}, opener.kwargs, {})
    raise UnsupportedError(f"{opener.name}(...).{closer.name}()")


def windowed_function(cube: Cube, window: dict[str, int], said: Any, closer: Step) -> Cube:
    """A function of a numpy array over each window, missing cells as NaN; null where fewer than min_periods are present."""
    from . import reductions

    least = said.get("min_periods")
    if least is None:
        least = 1
        for w in window.values():
            least *= w
    func = closer.args[0] if closer.args else closer.kwargs["func"]
    center = said.get("center", False)
    wide = cube
    for d, size in window.items():
        wide = construct(wide, d, size, {"center": center.get(d, False) if isinstance(center, dict) else center}, Step("construct", ({d: f"{d}+window"},)))
    extra = {f"{d}+window" for d in window}
    held = replace(wide, groups=tuple(g for g in wide.groups if extra & set(g.dims)))
    made = reductions.by_function(held, func, extra)
    counts = reductions.reduced(held, "count", extra)
    groups = [g for g in cube.groups if not set(window) & set(g.dims)]
    for g, n in zip(made.groups, counts.groups):
        both = g.df.join(n.df.select(*(f"`{k}`" for k in n.keys()), *(F.col(f"`{v}`").alias(f"#{v}") for v in n.vars)), n.keys())
        groups.append(replace(g, df=both.select(*(f"`{k}`" for k in g.keys()), *(F.when(F.col(f"`#{v}`") >= least, F.col(f"`{v}`")).alias(v) for v in g.vars))))
    return replace(cube, axes=made.axes, groups=tuple(groups))


def construct(cube: Cube, dim: str, size: int, said: Any, closer: Step) -> Cube:
    """A new dimension with the cells of each window."""
    from ..model import Axis

    new = closer.args[0] if closer.args else closer.kwargs.get("window_dim")
    new = new[dim] if isinstance(new, dict) else new
    before = size // 2 if said.get("center") else size - 1
    cube = windowed.in_place(cube, dim)
    groups = []
    for g in cube.groups:
        if dim in g.dims:
            df = g.df.withColumn(key(new), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
            df = df.withColumn(key(dim), F.col(f"`{key(dim)}`") + before - F.col(f"`{key(new)}`"))
            df = df.where((F.col(f"`{key(dim)}`") >= 0) & (F.col(f"`{key(dim)}`") < cube.axes[dim].n()))
            g = Group(df, (*g.dims, new), g.vars, False)
        groups.append(g)
    return replace(cube, axes={**cube.axes, new: Axis(new, None, (), size)}, groups=tuple(groups))


def exponential(cube: Cube, dim: str, size: float, kind: str, op: str) -> Cube:
    """Sums or means whose weights fall by a constant factor a position back. Weights of under 1e-18 aren't gathered."""
    alpha = {"span": 2 / (size + 1), "com": 1 / (1 + size), "halflife": 1 - 0.5 ** (1 / size), "alpha": size}[kind]
    import math

    cube = windowed.in_place(cube, dim)
    reach = max(1, math.ceil(-18 * math.log(10) / math.log1p(-alpha))) if alpha < 1 else 1
    groups = []
    for g in cube.groups:
        own = [v for v in g.vars if v not in cube.coords]
        if dim in g.dims and own:
            g = cube.densify(g)
            others = [f"`{x}`" for x in g.keys([dim])]
            k = f"`{key(dim)}`"
            if not others:
                g = replace(g, df=windowed.in_blocks(g.df, k, max(windowed.BLOCK, reach), reach, 0))
            w = Window.partitionBy(*(others or ["@block"])).orderBy(k).rangeBetween(-reach, 0)

            def value(v: str, k: str = k, w: Any = w) -> Column:
                cells = F.collect_list(F.when(F.col(f"`{v}`").isNotNull(), F.struct(F.col(k).alias("k"), F.col(f"`{v}`").cast("double").alias("x")))).over(w)
                weight = lambda p: F.pow(F.lit(1 - alpha), (F.col(k) - p["k"]).cast("double"))
                total = F.aggregate(cells, F.lit(0.0), lambda a, p: a + weight(p) * p["x"])
                return total if op == "sum" else F.try_divide(total, F.aggregate(cells, F.lit(0.0), lambda a, p: a + weight(p)))

            made = g.df.select(*(f"`{x}`" for x in g.keys()), *((F.col(f"`{v}`") if v in cube.coords else value(v)).alias(v) for v in g.vars), *([] if others else ["@own", "@block"]))
            g = replace(g, df=made if others else made.where("`@own` = `@block`").drop("@own", "@block"))
        groups.append(g)
    return replace(cube, groups=tuple(groups))


# Calls that stand alone


def where(cube: Cube, cond: Any, other: Any = None, drop: bool = False) -> Cube:
    """Cells where cond holds, else `other` or missing. cond is a Column, SQL text or a function of the cube, over variables and labels."""
    cond = cond(cube) if callable(cond) and not isinstance(cond, Column) else cond
    cond = F.expr(cond) if isinstance(cond, str) else cond
    text = str(cond._jc.toString()) if hasattr(cond, "_jc") else str(cond)
    groups = []
    for g in cube.merged():
        own = [v for v in g.vars if v not in cube.coords]
        full = cube.densify(g) if other is not None else g
        df, added = full.df, []
        for d in g.dims:
            axis = cube.axes[d]
            if names := [c for c in axis.coords if c not in g.vars and re.search(rf"(?<![\w.])`?{re.escape(c)}`?(?!\w)", text)]:
                df = df.join(axis.frame().select(f"`{key(d)}`", *(f"`{c}`" for c in names)), key(d))
                added += names
        value = lambda v: F.when(cond, F.col(f"`{v}`")) if other is None else F.when(cond, F.col(f"`{v}`")).otherwise(F.lit(other))
        if drop:
            df = df.where(cond)
        groups.append(replace(full, df=df.select(*(f"`{k}`" for k in g.keys()), *(value(v).alias(v) if v in own else F.col(f"`{v}`") for v in g.vars)), dense=full.dense and not drop))
    return replace(cube, groups=tuple(groups))


def assign(cube: Cube, variables: Any = None, **named: Any) -> Cube:
    """New variables from Columns, SQL text or functions of the cube, over variables of the same dimensions."""
    groups = list(cube.merged())
    for name, made in {**dict(variables or {}), **named}.items():
        made = made(cube) if callable(made) and not isinstance(made, Column) else made
        c = F.expr(made) if isinstance(made, str) else made if isinstance(made, Column) else F.lit(made)
        for i, g in enumerate(groups):
            try:
                df = g.df.select("*", c.alias("@new")) if name in g.vars else g.df.withColumn(name, c)
                df.schema  # noqa: B018  resolves now, or not here
            except AnalysisException:  # it names what this set of dimensions lacks
                continue
            df = df.drop(name).withColumnRenamed("@new", name) if name in g.vars else df
            groups[i] = Group(df, g.dims, tuple(dict.fromkeys((*g.vars, name))), g.dense)
            break
        else:
            raise ValueError(f"{name} can't be made from variables of the same dimensions")
    return replace(cube, groups=tuple(groups))


def fillna(cube: Cube, value: Any) -> Cube:
    """By variable from a dict, or from another cube's variables of the same names and dimensions."""
    groups = []
    for g in cube.groups:
        if isinstance(value, dict):
            full = cube.densify(g) if any(v in value for v in g.vars) else g
            groups.append(full.select({v: F.coalesce(F.col(f"`{v}`"), F.lit(value[v])) if v in value else F.col(f"`{v}`") for v in g.vars}))
            continue
        other = value.plan.collect() if isinstance(value, Cube) else None
        if other is None:
            raise UnsupportedError("fill from a number, a dict or a cube")
        full, theirs = cube.densify(g), {v: h for h in other.groups for v in h.vars}
        df = full.df
        for v in g.vars:
            h = theirs.get(v) or (next(iter(theirs.values())) if other.array else None)
            if h is not None and v not in cube.coords:
                name = v if v in h.vars else h.vars[0]
                shared = [key(d) for d in h.dims if d in g.dims]
                side = h.df.select(*(f"`{k}`" for k in shared), F.col(f"`{name}`").alias("@fill"))
                df = (df.join(side, shared, "left") if shared else df.crossJoin(F.broadcast(side))).withColumn(v, F.coalesce(F.col(f"`{v}`"), F.col("@fill"))).drop("@fill")
        groups.append(replace(full, df=df))
    return replace(cube, groups=tuple(groups))


def getitem(cube: Cube, wanted: Any) -> Cube:
    """Of an array, by position; of a dataset, a dict of positions or a mask over cells."""
    if isinstance(wanted, dict):
        return _select(cube, "isel", wanted)
    if isinstance(wanted, (Column,)):
        return where(cube, wanted)
    if cube.array:
        dims = list(cube.groups[0].dims)
        given = wanted if isinstance(wanted, tuple) else (wanted,)
        if any(isinstance(x, str) for x in given):
            from ..plans.steps import Project
            from .variables import project

            return project(cube, Project("__getitem__", (wanted,), key=wanted))
        return _select(cube, "isel", dict(zip(dims, given)))
    from .variables import project

    return project(cube, step_of("__getitem__", (wanted,), {}))  # type: ignore[arg-type]


def _select(cube: Cube, name: str, index: Any = None, **named: Any) -> Cube:
    """Selections by an array along other dimensions: those take the indexed one's place."""
    from ..model import Axis
    from ..plans.specs import Pointwise
    from ..plans.specs import classify_index as classify

    plain, arrays = {}, {}
    for d, v in {**dict(index or {}), **{k: v for k, v in named.items() if k not in ("drop", "method", "tolerance", "missing_dims")}}.items():
        spec = classify(d, v, name == "sel")
        (arrays if isinstance(spec, Pointwise) else plain)[d] = spec
    from ..plans.steps import Select

    cube = selection.run(cube, Select(name, (), {}, index=plain, options={k: v for k, v in named.items() if k in ("drop", "method", "tolerance", "missing_dims")}))
    if not arrays:
        return cube
    new = next(iter(arrays.values())).value.dims
    rows: dict[tuple, list[int]] = {}
    for d, spec in arrays.items():
        array: SmallArray = spec.value
        if array.dims != new:
            raise UnsupportedError("arrays that select together have the same dimensions")
        axis = cube.axes[d]
        order = list(axis.order())
        import numpy as np

        for at in np.ndindex(array.values.shape):
            x = array.values[at]
            base = order[int(x)] if name == "isel" else order[selection.by_label(axis, x.item() if hasattr(x, "item") else x).value]
            rows.setdefault(at, []).append(base)
    table = cube.spark.createDataFrame([(*map(int, at), *map(int, base)) for at, base in rows.items()], ", ".join([*(f"`{key(n)}` long" for n in new), *(f"`{key(d)}` long" for d in arrays)]))
    groups = []
    for g in cube.groups:
        shared = [d for d in arrays if d in g.dims]
        if shared:
            side = table.select(*(f"`{key(n)}`" for n in new), *(f"`{key(d)}`" for d in shared)).distinct()
            df = g.df.join(F.broadcast(side), [key(d) for d in shared]).drop(*(key(d) for d in shared))  # the index came from the driver
            g = Group(df, (*new, *(d for d in g.dims if d not in shared)), g.vars, g.dense)
        groups.append(g)
    first: SmallArray = next(iter(arrays.values())).value
    axes = {d: a for d, a in cube.axes.items() if d not in arrays}
    for n, size in zip(new, first.values.shape):
        given = first.coords.get(n)
        axes[n] = Axis(n, cube.spark.createDataFrame([(i, x) for i, x in enumerate(given)], f"`{key(n)}` long, `{n}` {'string' if isinstance(given[0], str) else 'double' if isinstance(given[0], float) else 'long'}"), (n,), size) if given else Axis(n, None, (), size)
    return replace(cube, axes=axes, groups=tuple(groups))


def transpose(cube: Cube, *dims: Any, **_: Any) -> Cube:
    """The order of dimensions, which is that of a result's columns and of numpy arrays."""
    order = list(dims) if dims and Ellipsis not in dims else None
    def turned(g: Group) -> Group:
        own = tuple(reversed(g.dims)) if order is None else tuple(d for d in order if d in g.dims) + tuple(d for d in g.dims if d not in order)
        return replace(g, dims=own)
    return replace(cube, groups=tuple(map(turned, cube.groups)))


def end(cube: Cube, dim: str | None = None, *, last: bool = False) -> Cube:
    """The first or last present cell along a dimension, for each variable that has it."""
    groups = []
    dims = [dim] if isinstance(dim, str) else list(dim or cube.dims)
    for g in cube.groups:
        gone = [d for d in dims if d in g.dims]
        if gone:
            order = F.struct(*(f"`{key(d)}`" for d in gone))
            pick = F.max_by if last else F.min_by
            left = tuple(d for d in g.dims if d not in gone)
            made = [pick(F.col(f"`{v}`"), F.when(F.col(f"`{v}`").isNotNull(), order)).alias(v) for v in g.vars if v not in cube.coords]
            g = Group(g.df.groupBy(*(f"`{key(d)}`" for d in left)).agg(*made) if left else g.df.agg(*made), left, tuple(v for v in g.vars if v not in cube.coords), g.dense)
        groups.append(g)
    return replace(cube, axes={d: a for d, a in cube.axes.items() if d not in dims}, groups=tuple(groups))


def quantile(cube: Cube, q: Any, dim: Any = None, **_: Any) -> Cube:
    """One quantile, or several along a new dimension that is called quantile."""
    if hasattr(q, "__iter__"):
        return along_quantiles(cube, [float(x) for x in q], lambda one: quantile(cube, one, dim))
    gone = set(cube.dims if dim is None else [dim] if isinstance(dim, str) else dim)
    groups = []
    for g in cube.groups:
        left = tuple(d for d in g.dims if d not in gone)
        own = [v for v in g.vars if v not in cube.coords]
        made = [F.percentile(F.col(f"`{v}`"), F.lit(float(q))).alias(v) for v in own]
        if len(left) < len(g.dims):
            g = Group(g.df.groupBy(*(f"`{key(d)}`" for d in left)).agg(*made) if left else g.df.agg(*made), left, tuple(own), g.dense)
        groups.append(g)
    return replace(cube, axes={d: a for d, a in cube.axes.items() if d not in gone}, groups=tuple(groups))


def along_quantiles(cube: Cube, qs: list[float], one: Any) -> Cube:
    """The results for all quantiles, each at its position of a new dimension."""
    from ..model import Axis

    parts = [one(q) for q in qs]
    k = key("quantile")
    axis = Axis("quantile", cube.spark.createDataFrame(list(enumerate(qs)), f"`{k}` long, `quantile` double"), ("quantile",), len(qs))
    groups = []
    for same in zip(*(p.groups for p in parts)):
        g = same[0]
        if not any(v not in cube.coords for v in g.vars):
            groups.append(g)
            continue
        df = None
        for i, h in enumerate(same):
            own = h.df.withColumn(k, F.lit(i).cast("long"))
            df = own if df is None else df.unionByName(own)
        groups.append(Group(df, ("quantile", *g.dims), g.vars, g.dense))
    return replace(parts[0], axes={"quantile": axis, **parts[0].axes}, groups=tuple(groups))


def interpolate_na(cube: Cube, dim: str, method: str = "linear", **_: Any) -> Cube:
    """Missing cells between present ones along a dimension, on a straight line over its labels or positions."""
    groups = []
    for g in cube.groups:
        own = [v for v in g.vars if v not in cube.coords]
        if dim in g.dims and own:
            g = cube.densify(g)
            axis, df, x = cube.axes[dim], g.df, F.col(f"`{key(dim)}`").cast("double")
            if dim in axis.coords and axis.table.schema[dim].dataType.typeName() in ("long", "integer", "double"):
                df, x = df.join(axis.frame().select(f"`{key(dim)}`", F.col(f"`{dim}`").cast("double").alias("@x")), key(dim)), F.col("@x")
            others, data = [f"`{k}`" for k in g.keys([dim])], [v for v in g.vars if v not in cube.coords]
            known = {v: F.when(F.col(f"`{v}`").isNotNull(), F.struct(x.alias("x"), F.col(f"`{v}`").alias("y"))) for v in data}
            if not others:  # blocks, with the nearest present cells of those before and after
                block, k = F.floor(F.col(f"`{key(dim)}`") / scans.BLOCK), F.col(f"`{key(dim)}`")
                df = df.withColumn("@block", block)
                ends = df.groupBy("@block").agg(*[e for v in data for e in (F.max_by(known[v], F.when(F.col(f"`{v}`").isNotNull(), k)).alias(f"@last {v}"), F.min_by(known[v], F.when(F.col(f"`{v}`").isNotNull(), k)).alias(f"@first {v}"))])
                past, next_ = Window.orderBy("@block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("@block").rowsBetween(1, Window.unboundedFollowing)  # a row a block
                ends = ends.select("@block", *[e for v in data for e in (F.last(f"@last {v}", True).over(past).alias(f"@back {v}"), F.first(f"@first {v}", True).over(next_).alias(f"@ahead {v}"))])
                df = df.join(ends, "@block")
            w = Window.partitionBy(*(others or ["@block"])).orderBy(f"`{key(dim)}`")
            back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)

            def value(v: str, x: Column = x, back: Any = back, ahead: Any = ahead, known: dict = known, alone: bool = not others) -> Column:
                c, low, high = F.col(f"`{v}`"), F.last(known[v], True).over(back), F.first(known[v], True).over(ahead)
                if alone:
                    low, high = F.coalesce(low, F.col(f"`@back {v}`")), F.coalesce(high, F.col(f"`@ahead {v}`"))
                return F.coalesce(c, low["y"] + (high["y"] - low["y"]) * F.try_divide(x - low["x"], high["x"] - low["x"]))

            g = replace(g, df=df.select(*(f"`{k}`" for k in g.keys()), *(F.col(f"`{v}`") if v in cube.coords else value(v).alias(v) for v in g.vars)))
        groups.append(g)
    return replace(cube, groups=tuple(groups))


def interp(cube: Cube, coords: Any = None, method: str = "linear", **named: Any) -> Cube:
    """Values at new labels of dimensions, on straight lines between the labels on either side; missing beyond them, and beside missing cells.

    The new labels come from the driver, as do the labels next to them, found by one aggregation over the axis.
    """
    from ..model import Axis

    if method not in ("linear", "nearest"):
        raise UnsupportedError(f"interp by {method!r}")
    for d, wanted in {**dict(coords or {}), **{k: v for k, v in named.items() if k in cube.axes}}.items():
        axis, single = cube.axes[d], not hasattr(wanted, "__iter__") or isinstance(wanted, str)
        own = selection.Labels(axis)
        values = [own.like(x) for x in ([wanted] if single else list(wanted))]
        weights = []
        for i, x in enumerate(values):
            found = own.beside(x)
            if found is None:
                continue
            (x0, k0), (x1, k1) = found
            share = 0.0 if x1 == x0 else (x - x0) / (x1 - x0)
            if method == "nearest":
                share = float(share > 0.5)
            weights += [(k0, i, 1 - share)] * (share < 1) + [(k1, i, share)] * (share > 0)
        k, new = key(d), f"{key(d)}+"
        table = cube.spark.createDataFrame(weights, f"`{k}` long, `{new}` long, `@w` double")
        needed = table.groupBy(new).agg(F.count("*").alias("@n"))
        groups = []
        for g in cube.groups:
            data = [v for v in g.vars if v not in cube.coords]
            if d not in g.dims:
                groups.append(g)
            elif data:
                cells = g.df.join(F.broadcast(table), k).join(F.broadcast(needed), new)  # both came from the driver
                left = [f"`{x}`" for x in g.keys([d])]
                made = [F.when(F.count(F.col(f"`{v}`")) == F.max("@n"), F.sum(F.col(f"`{v}`") * F.col("@w"))).alias(v) for v in data]
                df = cells.groupBy(f"`{new}`", *left).agg(*made).withColumnRenamed(new, k)
                groups.append(Group(df, g.dims, tuple(data)))
        typed = cube.spark.createDataFrame([(i, float(x) if isinstance(x, (int, float)) else x) for i, x in enumerate(values)], f"`{k}` long, `{d}` {'timestamp_ntz' if own.dated else 'double'}")
        cube = replace(cube, axes={**cube.axes, d: Axis(d, typed, (d,), len(values))}, groups=tuple(groups))
        if single:
            cube = selection.one(cube, cube.axes[d], 0)
    return cube


def stack(cube: Cube, dim: Any = None, **named: Any) -> Cube:
    """Several dimensions as one, the last of them fastest; their labels stay as coordinates along it."""
    from ..model import Axis

    for new, dims in {**dict(dim or {}), **{k: v for k, v in named.items() if k not in ("create_index", "index_cls")}}.items():
        dims = list(cube.dims if dims is Ellipsis or Ellipsis in dims else dims)
        for d in dims:
            cube = windowed.in_place(cube, d)
        sizes = [cube.axes[d].n() for d in dims]

        def merged(df: Any, dims: list = dims, sizes: list = sizes, new: str = new) -> Any:
            at = F.lit(0).cast("long")
            for d, n in zip(dims, sizes):
                at = at * n + F.col(f"`{key(d)}`")
            return df.withColumn(key(new), at)

        groups, names = [], []
        for g in cube.groups:
            if set(dims) & set(g.dims):
                missing = [d for d in dims if d not in g.dims]
                df = cube.grid(missing).crossJoin(g.df) if missing else g.df  # repeated along what it lacks, as the result is
                g = Group(merged(df).drop(*(key(d) for d in dims)), (*(d for d in g.dims if d not in dims), new), g.vars, g.dense)
            groups.append(g)
        table = merged(cube.grid(dims))
        for d in dims:
            axis = cube.axes[d]
            if axis.table is not None and axis.coords:
                table = table.join(axis.frame().select(f"`{key(d)}`", *(f"`{c}`" for c in axis.coords)), key(d))
                names += axis.coords
            else:
                table, names = table.withColumn(d, F.col(f"`{key(d)}`")), [*names, d]
        table = table.select(f"`{key(new)}`", *(f"`{c}`" for c in names))
        total = 1
        for n in sizes:
            total *= n
        axes = {d: a for d, a in cube.axes.items() if d not in dims}
        cube = replace(cube, axes={**axes, new: Axis(new, table, tuple(names), total)}, groups=tuple(groups))
    return cube


def to_dataset(cube: Cube, **_: Any) -> Cube:
    return replace(cube, array=False)


def get(cube: Cube, name: str, default: Any = None) -> Cube:
    return getitem(cube, name) if name in cube.shape.variables else default


_CALLS = {
    "where": where, "assign": assign, "fillna": fillna, "__getitem__": getitem, "transpose": transpose, "quantile": quantile, "interpolate_na": interpolate_na, "interp": interp, "stack": stack, "to_dataset": to_dataset, "get": get,
    "pipe": lambda cube, f, *a, **k: f(cube, *a, **k),
    "map": lambda cube, f, *a, **k: replace(cube, groups=tuple(g.select({v: F.col(f"`{v}`") if v in cube.coords else f(F.col(f"`{v}`"), *a, **k) for v in g.vars}) for g in cube.groups)),
    "first": lambda cube, dim=None, **_: end(cube, dim), "last": lambda cube, dim=None, **_: end(cube, dim, last=True),
    "isel": lambda cube, index=None, **k: _select(cube, "isel", index, **k), "sel": lambda cube, index=None, **k: _select(cube, "sel", index, **k),
    "astype": lambda cube, *a, **k: elementwise(cube, Elementwise("astype", a, k)), "round": lambda cube, *a, **k: elementwise(cube, Elementwise("round", a, k)),
    "clip": lambda cube, *a, **k: elementwise(cube, Elementwise("clip", a, k)),
}
CALLS = frozenset(_CALLS)
