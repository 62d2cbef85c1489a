"""Reductions over groups of a dimension: parts of dates, labels, bins, other coordinates and resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedError
from ..functions import dates
from ..functions.aggregates import aggregate, alone
from ..model import Axis, Cube, Group, SmallArray, key, spark_type
from ..plans.steps import GroupedReduce, Step, dims_of
from .reductions import by_cells, options, reduced


class Grouping:
    """Where a grouper puts the positions of its dimensions: (keys, new key) rows, and the new axis."""

    def __init__(self, dims: tuple[str, ...], new: str, places: DataFrame, axis: Axis):
        self.dims, self.new, self.places, self.axis = dims, new, places, axis


def grouping(cube: Cube, opener: Step) -> Grouping:
    """Worked out on the tables of axes (or of the coordinate that groups), never on the cells."""
    args, kwargs = opener.args, opener.kwargs
    if opener.name == "resample":
        how = {k: kwargs[k] for k in ("closed", "label", "offset", "origin") if kwargs.get(k) is not None}
        given = {**dict(args[0] if args else {}), **{k: v for k, v in kwargs.items() if k not in RESAMPLE_OPTIONS}}
        if len(given) != 1 or not all(isinstance(v, str) and k in cube.axes for k, v in given.items()):
            raise UnsupportedError(f"resample one dimension by a code such as '1D'; there are {list(cube.axes)}")
        return _resampled(cube, *next(iter(given.items())), **how)
    by = args[0] if args else kwargs.get("group")
    if isinstance(by, SmallArray):
        return _by_array(cube, by, opener)
    if not isinstance(by, str):
        raise UnsupportedError("group by the name of a coordinate, by coordinate.part, or by an array along a dimension")
    name, _, part = by.partition(".")
    if opener.name == "groupby_bins":
        return _binned(cube, name, args[1] if len(args) > 1 else kwargs["bins"], kwargs)
    dims, table = _coordinate(cube, name)
    label = F.col(f"`{name}`")
    new = part or name
    return _numbered(dims, new, table.select(*(f"`{key(d)}`" for d in dims), (dates.part(label, part) if part else label).alias(new)))


#: What resample() takes besides the dimension; the last three change no value here.
RESAMPLE_OPTIONS = ("closed", "label", "offset", "origin", "skipna", "keep_attrs", "restore_coord_dims")


def _by_array(cube: Cube, by: SmallArray, opener: Step) -> Grouping:
    """Groups by the values of an array along one dimension, in its order of positions; the new dimension is called group (or group_bins)."""
    if len(by.dims) != 1 or by.dims[0] not in cube.axes:
        raise UnsupportedError("an array that groups is along one dimension of the cube")
    axis = cube.axes[by.dims[0]]
    order = list(axis.order())
    if len(order) != len(by.values):
        raise ValueError(f"{axis.dim!r} has {len(order)} positions, and the array {len(by.values)}")
    rows = [(int(k), None if isinstance(x, float) and x != x else x) for k, x in zip(order, by.values.tolist())]
    table = cube.spark.createDataFrame(rows, T.StructType([T.StructField(key(axis.dim), T.LongType()), T.StructField("group", spark_type(by.values))]))
    if opener.name == "groupby_bins":
        return _binned(cube, "group", opener.args[1] if len(opener.args) > 1 else opener.kwargs["bins"], opener.kwargs, ((axis.dim,), table))
    return _numbered((axis.dim,), "group", table)


def _coordinate(cube: Cube, name: str) -> tuple[tuple[str, ...], DataFrame]:
    axis = cube.axis_of(name)
    if axis is not None:
        return (axis.dim,), axis.frame()
    if name in cube.axes:
        a = cube.axes[name]
        place = a.place()
        if place is None:
            raise UnsupportedError(f"{name!r} has no labels to group by")
        return (name,), a.frame().withColumn(name, place)
    g = cube.group_of(name)
    return g.dims, g.df


def _numbered(dims: tuple[str, ...], new: str, labelled: DataFrame) -> Grouping:
    """Groups in order of their labels. The window is over the distinct labels of one axis."""
    labelled = labelled.where(F.col(f"`{new}`").isNotNull())
    table = labelled.select(f"`{new}`").distinct().withColumn(f"{key(new)}+", F.row_number().over(Window.orderBy(f"`{new}`")).cast("long") - 1)
    places = labelled.join(table, new).select(*(f"`{key(d)}`" for d in dims), f"`{key(new)}+`")
    return Grouping(dims, new, places, Axis(new, table.withColumnRenamed(f"{key(new)}+", key(new)), (new,)))


def edge_names(edges: Sequence[Any], right: bool) -> list[str]:
    """The bins' names, with as many digits as tell their edges apart."""
    digits = next((n for n in range(4, 17) if len({f"{e:.{n}g}" for e in edges}) == len(set(edges))), 17)
    text = [f"{e:.{digits}g}" for e in edges]
    return [f"({a}, {b}]" if right else f"[{a}, {b})" for a, b in zip(text, text[1:])]


def _binned(cube: Cube, name: str, bins: Any, kwargs: Any, source: tuple[tuple[str, ...], DataFrame] | None = None) -> Grouping:
    """Bins (a, b]; a number means as many of equal width, the first a thousandth wider to hold the least label."""
    dims, table = source or _coordinate(cube, name)
    right, lowest = kwargs.get("right", True), kwargs.get("include_lowest", False)
    if isinstance(bins, int):
        low, high = table.agg(F.min(f"`{name}`"), F.max(f"`{name}`")).first()
        width = (high - low) / bins
        edges = [low + i * width for i in range(bins)] + [high]
        if right:
            edges[0] -= (high - low) * 0.001
        else:
            edges[-1] += (high - low) * 0.001
    else:
        edges = list(bins)
    c, new = F.col(f"`{name}`"), f"{name}_bins"
    where = F.lit(None).cast("long")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = ((c > a) & (c <= b)) if right else ((c >= a) & (c < b))
        if lowest and i == 0 and right:
            inside = inside | (c == a)
        where = F.when(inside, F.lit(i).cast("long")).otherwise(where)
    names = kwargs.get("labels") or edge_names(edges, right)
    axis = Axis(new, cube.spark.createDataFrame([(i, str(n)) for i, n in enumerate(names)], f"`{key(new)}` long, `{new}` string"), (new,), len(names))
    places = table.select(*(f"`{key(d)}`" for d in dims), where.alias(f"{key(new)}+")).where(f"`{key(new)}+` is not null")
    return Grouping(dims, new, places, axis)


def _resampled(cube: Cube, dim: str, code: str, closed: str | None = None, label: str | None = None, offset: Any = None, origin: Any = "start_day") -> Grouping:
    """Bins that cover all labels, the empty ones between included, as pandas cuts and names them.

    closed says which end of a bin belongs to it and label which end it is called by: the left one, but for bins that end on a month's, quarter's or
    year's last day or on a weekday. Bins of a fixed length begin at the origin (the first label's midnight, 'start', 'epoch' or a time) plus offset.
    """
    axis, rule = cube.axes[dim], dates.step(code)
    closed, label = closed or rule.side, label or rule.side
    if {closed, label} - {"left", "right"}:
        raise ValueError("closed and label are 'left' or 'right'")
    if not rule.fixed and (offset is not None or origin != "start_day"):
        raise UnsupportedError(f"offset and origin with {code!r}, whose bins begin where the calendar has it")
    frame, at = axis.frame(), F.col(f"`{dim}`").cast("timestamp_ntz")
    first, last = frame.agg(F.min(at), F.max(at)).first()
    if first is None:
        raise ValueError(f"{dim!r} has no labels to resample")
    number = F.col(f"`{key(dim)}`")
    if rule.unit == "MONTH":
        moved = at + F.expr("interval 1 day") if rule.ends and closed == "left" else at - F.expr("interval 1 microsecond") if not rule.ends and closed == "right" else at
        months = F.year(moved) * 12 + F.month(moved) - 1
        bin_ = F.floor(months / rule.n) if rule.n in (3, 12) else F.floor((months - frame.agg(F.min(months)).first()[0]) / rule.n)
        base = 0 if rule.n in (3, 12) else frame.agg(F.min(months)).first()[0]

        def name(k: Column) -> Column:
            step = (k + F.lit(int(label == "right"))) * rule.n + base
            day = F.make_date(F.floor(step / 12).cast("int"), (step % 12 + 1).cast("int"), F.lit(1))
            return (F.date_sub(day, 1) if rule.ends else day).cast("timestamp_ntz")
    else:
        if rule.unit == "WEEK":  # whole days: a bin ends with its weekday
            start = datetime(1970, 1, 1) + timedelta(days=(rule.weekday - 3) % 7)  # 1970 began on a Thursday
            at = F.date_trunc("day", at).cast("timestamp_ntz")
        else:
            start = _origin(origin, first) + _delta(offset)
        length = rule.n * 1_000_000
        since = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{start:%Y-%m-%d %H:%M:%S.%f}', {{}})".format(f"date_trunc('day', cast(`{dim}` as timestamp_ntz))" if rule.unit == "WEEK" else f"cast(`{dim}` as timestamp_ntz)"))
        bin_ = F.floor(since / length) if closed == "left" else F.ceil(since / length) - 1

        def name(k: Column) -> Column:
            seconds = (k + F.lit(int(label == "right"))) * rule.n
            return F.lit(f"{start:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz") + F.make_dt_interval(F.floor(seconds / 86400).cast("int"), F.lit(0), F.lit(0), (seconds % 86400).cast("decimal(18,6)"))
    placed = frame.select(f"`{key(dim)}`", bin_.cast("long").alias(f"{key(dim)}+"))
    low, high = placed.agg(F.min(f"`{key(dim)}+`"), F.max(f"`{key(dim)}+`")).first()
    table = cube.spark.range(high - low + 1).select(F.col("id").alias(key(dim))).withColumn(dim, name(number + low))
    return Grouping((dim,), dim, placed.withColumn(f"{key(dim)}+", F.col(f"`{key(dim)}+`") - low), Axis(dim, table, (dim,), high - low + 1))


def _origin(origin: Any, first: datetime) -> datetime:
    if isinstance(origin, datetime):
        return origin
    known = {"start_day": datetime(first.year, first.month, first.day), "start": first, "epoch": datetime(1970, 1, 1)}
    if origin in known:
        return known[origin]
    try:
        return datetime.fromisoformat(origin)
    except (TypeError, ValueError):
        raise UnsupportedError(f"origin {origin!r}; there are {sorted(known)} and times") from None


def _delta(offset: Any) -> timedelta:
    if offset is None or isinstance(offset, timedelta):
        return offset or timedelta()
    rule = dates.step(str(offset).lstrip("+-"))
    if not rule.fixed or rule.unit == "WEEK":
        raise UnsupportedError(f"offset {offset!r}")
    return timedelta(seconds=rule.n) * (-1 if str(offset).startswith("-") else 1)


def run(cube: Cube, step: GroupedReduce) -> Cube:
    how = grouping(cube, step)
    return reduce_groups(cube, how, step.closer.name, step.dims.names | set(how.dims), options(step.closer))


def closed(cube: Cube, opener: Step, closer: Step) -> Cube:
    """A pair that the plan couldn't fuse: other coordinates, maps over groups, first and last."""
    how = grouping(cube, opener)
    if closer.name == "__getitem__":
        return pick(cube, how, closer.args[0])
    dims = dims_of(closer.kwargs.get("dim", closer.args[0] if closer.args and closer.name not in ("quantile", "map", "reduce") else None))
    if closer.kwargs.get("keepdims"):
        raise UnsupportedError("keepdims after a grouping")
    if not dims.every and not set(how.dims) & dims.names and closer.name not in ("first", "last"):
        return mapped(reduced(cube, closer.name, dims.names, **options(closer)), how)
    gone = set(how.dims) | (set() if dims.every else set(dims.names))
    if closer.name == "map":
        return map_groups(cube, how, closer.args[0] if closer.args else closer.kwargs["func"], closer)
    if closer.name == "reduce":
        over = dims_of(closer.args[1] if len(closer.args) > 1 else closer.kwargs.get("dim"))
        return reduce_by_function(cube, how, closer.args[0] if closer.args else closer.kwargs["func"], set(how.dims) | (set() if over.every else set(over.names)))
    if closer.name == "quantile":
        q = closer.args[0] if closer.args else closer.kwargs["q"]
        if hasattr(q, "__iter__"):
            from .opaque import along_quantiles

            return along_quantiles(cube, [float(x) for x in q], lambda one: closed(cube, opener, Step("quantile", (one,), {k: v for k, v in closer.kwargs.items() if k != "q"})))
        return reduce_groups(cube, how, lambda v, kind: F.percentile(v, F.lit(float(q))), gone, {})
    if closer.name in ("first", "last"):
        order = F.struct(*(f"`{key(d)}`" for d in how.dims))
        pick_ = F.min_by if closer.name == "first" else F.max_by
        return reduce_groups(cube, how, lambda v, kind: pick_(v, F.when(v.isNotNull(), order)), gone, {})
    return reduce_groups(cube, how, closer.name, gone, options(closer))


def reduce_groups(cube: Cube, how: Grouping, op: str | Callable[[Column, Any], Column], gone: Sequence[str] | set, extra: dict) -> Cube:
    """Each variable over its groups. Every data variable gets the new dimension, those without the old one repeated along it."""
    gone, new, groups = set(gone), how.new, []
    for g in cube.groups:
        own = [v for v in g.vars if v not in cube.coords]
        if not own:
            if not gone & set(g.dims):
                groups.append(g)
            continue
        apply = (lambda v, kind: aggregate(op, v, kind, **extra)) if isinstance(op, str) else op  # noqa: B023
        shared = [d for d in how.dims if d in g.dims]
        left = tuple(d for d in g.dims if d not in gone)
        if shared:
            full = cube.densify(g) if op in ("sum", "prod", "count", "any", "all") else g
            cells = full.df.join(how.places, [key(d) for d in shared])
            made = [apply(F.col(f"`{v}`"), g.type_of(v)).alias(v) for v in own]
            if op == "any":
                made = [F.coalesce(F.bool_or(F.coalesce(F.col(f"`{v}`").cast("boolean"), F.lit(True))), F.lit(False)).alias(v) for v in own]
            df = cells.groupBy(f"`{key(new)}+`", *(f"`{key(d)}`" for d in left)).agg(*made)
            groups.append(Group(df.withColumnRenamed(f"{key(new)}+", key(new)), (new, *left), tuple(own)))
        else:
            extra_gone = gone & set(g.dims)
            part = reduced(replace(cube, groups=(replace(g, vars=tuple(own)),)), op, extra_gone).groups[0] if extra_gone and isinstance(op, str) else g.select({v: alone(op, F.col(f"`{v}`"), g.type_of(v)) if isinstance(op, str) else F.col(f"`{v}`") for v in own})
            df = how.axis.frame().select(f"`{key(new)}`").crossJoin(part.df)  # as large as the result, which repeats it
            groups.append(Group(df, (new, *part.dims), part.vars, part.dense))
    axes = {d: a for d, a in cube.axes.items() if d not in gone}
    return replace(cube, axes={new: how.axis, **axes}, groups=tuple(groups))


def reduce_by_function(cube: Cube, how: Grouping, func: Callable, gone: set[str]) -> Cube:
    """A function of a numpy array and an axis over the cells of each group; variables without the grouped dimension get the new one."""
    groups, new = [], how.new
    for g in cube.groups:
        own = tuple(v for v in g.vars if v not in cube.coords)
        shared = [d for d in how.dims if d in g.dims]
        if not own:
            if not gone & set(g.dims):
                groups.append(g)
            continue
        full = replace(cube.densify(g), vars=own)
        cells = full.df.join(how.places, [key(d) for d in shared]) if shared else how.axis.frame().select(F.col(f"`{key(new)}`").alias(f"{key(new)}+")).crossJoin(full.df)  # repeated along the groups
        left = tuple(d for d in g.dims if d not in gone)
        wide = cells.select(F.col(f"`{key(new)}+`").alias(key(f"{new}+")), *(f"`{k}`" for k in g.keys()), *(f"`{v}`" for v in own))
        one = by_cells(Group(wide, (f"{new}+", *g.dims), own, True), func, gone & set(g.dims), (f"{new}+", *left))
        groups.append(Group(one.df.withColumnRenamed(key(f"{new}+"), key(new)), (new, *left), own))
    return replace(cube, axes={new: how.axis, **{d: a for d, a in cube.axes.items() if d not in gone}}, groups=tuple(groups))


def map_groups(cube: Cube, how: Grouping, func: Callable, closer: Step) -> Cube:
    """A function of each group's cube, as a cube of the same dimension: where it keeps the positions the parts are put back, where it reduces them they lie along the groups.

    Each group is a part of the plan, so this is for a number of groups that a driver can list.
    """
    args = closer.args[1:] or closer.kwargs.get("args", ())
    extra = {k: v for k, v in closer.kwargs.items() if k not in ("func", "args", "shortcut")}
    names = [r[0] for r in how.axis.frame().orderBy(f"`{key(how.new)}`").select(f"`{how.new}`").collect()]
    parts = []
    for name in names:
        out = func(pick(cube, how, name), *args, **extra)
        parts.append(out if isinstance(out, Cube) else out.collect())
    kept = set(how.dims) <= set(parts[0].axes)
    groups = []
    for same in zip(*(p.groups for p in parts)):
        df = None
        for i, g in enumerate(same):
            own = g.df if kept else g.df.withColumn(key(how.new), F.lit(i).cast("long"))
            df = own if df is None else df.unionByName(own)
        dims = same[0].dims if kept else (how.new, *same[0].dims)
        groups.append(Group(df if not kept or set(how.dims) & set(dims) else same[0].df, dims, same[0].vars))
    if kept:
        return replace(cube, groups=tuple(groups))
    table = how.axis.frame().orderBy(f"`{key(how.new)}`").collect()
    axis = Axis(how.new, cube.spark.createDataFrame([(i, r[how.new]) for i, r in enumerate(table)], T.StructType([T.StructField(key(how.new), T.LongType()), how.axis.frame().schema[how.new]])), (how.new,), len(table))
    return replace(parts[0], axes={how.new: axis, **parts[0].axes}, groups=tuple(groups))


def mapped(cube: Cube, how: Grouping) -> Cube:
    """What is left of a map over groups that reduced other dimensions only: the grouped one stays, on every variable."""
    groups = []
    for g in cube.groups:
        missing = [d for d in how.dims if d not in g.dims]
        own = [v for v in g.vars if v not in cube.coords]
        if missing and own:
            g = Group(cube.grid(missing).crossJoin(g.df), (*missing, *g.dims), g.vars, g.dense)
        groups.append(g)
    return replace(cube, groups=tuple(groups))


def pick(cube: Cube, how: Grouping, label: Any) -> Cube:
    """The cells of one group, by its label."""
    own = how.axis.frame().where(F.col(f"`{how.new}`") == F.lit(label)).select(F.col(f"`{key(how.new)}`").alias(f"{key(how.new)}+"))
    places = how.places.join(F.broadcast(own), f"{key(how.new)}+", "left_semi")
    dim = how.dims[0]
    base = sorted(r[0] for r in places.select(f"`{key(dim)}`").distinct().collect())
    if not base:
        raise KeyError(f"{label!r} is not a group")
    axis = replace(cube.axes[dim], at=tuple(base), size=len(base))
    return replace(cube, axes={**cube.axes, dim: axis}, groups=tuple(replace(g, df=axis.keep(g.df)) if dim in g.dims else g for g in cube.groups))
