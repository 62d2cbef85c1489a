"""isel and sel: predicates on key columns, worked out on the axes."""

from __future__ import annotations

import math
from dataclasses import replace
from datetime import date, datetime, timedelta
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from ..model import Axis, Cube, Group, key
from ..plans.specs import Label, Positions, Scalar, Slice
from ..plans.steps import Select


def run(cube: Cube, step: Select) -> Cube:
    for dim, spec in step.index.items():
        if dim not in cube.axes:
            if step.options.get("missing_dims", "raise") != "raise":
                continue
            raise ValueError(f"no dimension is called {dim!r}; there are {list(cube.axes)}")
        if isinstance(spec, Label) and step.name == "sel":
            spec = by_label(cube.axes[dim], spec.value, step.options.get("method"), step.options.get("tolerance"))
        cube = positions(cube, dim, spec, bool(step.options.get("drop")))
    return cube


def positions(cube: Cube, dim: str, spec: Any, drop: bool = False) -> Cube:
    axis = cube.axes[dim]
    if isinstance(spec, Scalar):
        return one(cube, axis, spec.value, drop)
    if isinstance(spec, Slice):
        if spec.forward and axis.at is None and axis.size is None and spec.stop is not None:
            axis = replace(axis, size=axis.n())
        order = axis.order()[spec.raw()]
    elif isinstance(spec, Positions):
        whole = axis.order()
        if any(not -len(whole) <= i < len(whole) for i in spec.values):
            raise IndexError(f"a position is out of range for {dim!r} of size {len(whole)}")
        order = tuple(whole[i] for i in spec.values)
    else:
        raise TypeError(f"{dim!r} can't be indexed by position with {spec.value!r}")
    if isinstance(order, range):  # stays one, however long
        if order.step < 0 and len(order) > 1:
            return turned(cube, axis, order)
        return on_axis(cube, replace(axis, at=order if order.step > 0 else range(order[0], order[0] + 1) if len(order) else range(0), size=len(order)))
    steps = np.diff(np.asarray(order, np.int64))
    if (steps <= 0).any():
        return reordered(cube, axis, tuple(order))
    if not len(order):
        order = range(0)
    elif (steps == (steps[0] if len(steps) else 1)).all():
        order = range(order[0], order[-1] + 1, int(steps[0]) if len(steps) else 1)
    return on_axis(cube, replace(axis, at=order, size=len(order)))


def turned(cube: Cube, axis: Axis, order: range) -> Cube:
    """Positions that go back evenly: cells are numbered anew by arithmetic."""
    k = key(axis.dim)
    kept = replace(axis, at=order[::-1], size=len(order))
    moved = lambda df: kept.keep(df).withColumn(k, ((F.col(f"`{k}`") - order[0]) / order.step).cast("long"))
    groups = tuple(replace(g, df=moved(g.df)) if axis.dim in g.dims else g for g in cube.groups)
    own = replace(axis, table=moved(axis.table) if axis.table is not None else None, at=None, size=len(order))
    return replace(cube, axes={**cube.axes, axis.dim: own}, groups=groups)


def on_axis(cube: Cube, axis: Axis) -> Cube:
    """The cube with a narrower axis: a predicate for every DataFrame over it."""
    groups = tuple(replace(g, df=axis.keep(g.df)) if axis.dim in g.dims else g for g in cube.groups)
    return replace(cube, axes={**cube.axes, axis.dim: axis}, groups=groups)


def one(cube: Cube, axis: Axis, at: int, drop: bool = False) -> Cube:
    """A single position: the dimension goes, and its coordinates stay as scalars unless dropped."""
    whole = axis.order() if at < 0 or axis.at is not None or axis.size is not None else None
    if whole is not None and not -len(whole) <= at < len(whole):
        raise IndexError(f"position {at} is out of range for {axis.dim!r} of size {len(whole)}")
    base = int(whole[at]) if whole is not None else at
    k = F.col(f"`{key(axis.dim)}`")
    groups, scalars = [], dict(cube.scalars)
    for g in cube.groups:
        if axis.dim in g.dims:
            left = tuple(v for v in g.vars if not (drop and v in cube.coords))
            g = Group(g.df.where(k == base).select(*(f"`{c}`" for c in g.keys([axis.dim])), *(f"`{v}`" for v in left)), tuple(d for d in g.dims if d != axis.dim), left, g.dense)
            if not left:
                continue
        groups.append(g)
    if axis.table is not None and not drop:
        scalars |= {c: axis.table.where(k == base).select(f"`{c}`") for c in axis.coords}
    return replace(cube, axes={d: a for d, a in cube.axes.items() if d != axis.dim}, groups=tuple(groups), scalars=scalars)


def reordered(cube: Cube, axis: Axis, order: tuple[int, ...]) -> Cube:
    """Positions that repeat or go back: the only selection that numbers cells anew, by a join with the list."""
    k, new = key(axis.dim), f"{key(axis.dim)}+"
    places = cube.spark.createDataFrame([(int(b), i) for i, b in enumerate(order)], f"`{k}` long, `{new}` long")
    moved = lambda df: df.join(F.broadcast(places), k).drop(k).withColumnRenamed(new, k)  # noqa: E731  the list came from the driver
    groups = tuple(replace(g, df=moved(g.df)) if axis.dim in g.dims else g for g in cube.groups)
    own = replace(axis, table=moved(axis.table) if axis.table is not None else None, at=None, size=len(order))
    return replace(cube, axes={**cube.axes, axis.dim: own}, groups=groups)


def labels(axis: Axis) -> list:
    """The labels in order; reads the axis's table alone, to the driver."""
    if axis.dim not in axis.coords:
        return list(range(axis.n()))
    return [r[0] for r in axis.frame().orderBy(f"`{key(axis.dim)}`").select(f"`{axis.dim}`").collect()]


def _like(value: Any, label: Any, end: bool = False) -> Any:
    """A bound or label in the type of the axis's labels; a date in part ('2000-01') means its whole span."""
    value = value.item() if isinstance(value, np.generic) and not isinstance(value, np.datetime64) else value
    if isinstance(label, datetime):
        if isinstance(value, np.datetime64):
            return value.astype("datetime64[us]").item()
        if isinstance(value, str):
            first, last = span(value)
            return last if end else first
        if isinstance(value, date) and not isinstance(value, datetime):
            return datetime(value.year, value.month, value.day)
    return value


def span(text: str) -> tuple[datetime, datetime]:
    """The first and last microsecond that an ISO date of any precision means."""
    parts = text.replace("T", " ").split(" ")
    day = [int(x) for x in parts[0].split("-")]
    if len(parts) == 1 and len(day) < 3:
        first = datetime(*(day + [1] * (3 - len(day))))
        after = datetime(day[0] + 1, 1, 1) if len(day) == 1 else datetime(day[0] + day[1] // 12, day[1] % 12 + 1, 1)
    else:
        first = datetime.fromisoformat(text)
        clock = parts[1].count(":") if len(parts) > 1 else -1
        after = first + {-1: timedelta(days=1), 0: timedelta(hours=1), 1: timedelta(minutes=1)}.get(clock, timedelta(microseconds=1))
    return first, after - timedelta(microseconds=1)


class Labels:
    """An axis's labels, in order along it, asked by aggregations over its table; or its positions, where it has no labels."""

    def __init__(self, axis: Axis):
        self.axis, self.named = axis, axis.dim in axis.coords
        if self.named:
            self.frame, self.kind = axis.frame(), axis.table.schema[axis.dim].dataType
            self.label, self.key = F.col(f"`{axis.dim}`"), F.col(f"`{key(axis.dim)}`")

    @property
    def dated(self) -> bool:
        return self.named and self.kind.typeName().startswith(("timestamp", "date"))

    def like(self, value: Any, end: bool = False) -> Any:
        return _like(value, datetime.min if self.dated else None, end)

    def _lit(self, value: Any) -> Any:
        return F.lit(value.isoformat(" ")).cast(self.kind) if self.dated and isinstance(value, datetime) else F.lit(value)

    def place(self, base: int) -> int:
        """The position along the axis of a key of its table."""
        at = self.axis.at
        return base if at is None else at.index(base)

    def below(self, value: Any, too: bool) -> int:
        """How many labels lie below a value, or are it, if too."""
        if not self.named:
            n = self.axis.n()
            return min(max(math.floor(value) + 1 if too else math.ceil(value), 0), n)
        return self.frame.where(self.label <= self._lit(value) if too else self.label < self._lit(value)).count()

    def find(self, values: list) -> list[int]:
        """The positions of labels; each has to be one."""
        if not self.named:
            found = {v: int(v) for v in values if v == int(v) and 0 <= v < self.axis.n()}
        else:
            rows = self.frame.where(self.label.isin(*map(self._lit, values))).groupBy(self.label.alias("x")).agg(F.min(self.key).alias("k")).collect() if values else []
            found = {r["x"]: self.place(r["k"]) for r in rows}  # a row for each label that was asked for
            found |= {datetime(x.year, x.month, x.day): k for x, k in list(found.items()) if isinstance(x, date) and not isinstance(x, datetime)}
        for v in values:
            if v not in found:
                raise KeyError(f"{v!r} is not a label of {self.axis.dim!r}")
        return [found[v] for v in values]

    def near(self, value: Any, method: str, tolerance: Any) -> int:
        if method not in ("ffill", "pad", "bfill", "backfill", "nearest"):
            raise ValueError(f"no method is called {method!r}")
        if self.named:
            pair = F.struct(self.label.alias("x"), self.key.alias("k"))
            low, high = self.frame.agg(F.max(F.when(self.label <= self._lit(value), pair)), F.min(F.when(self.label >= self._lit(value), pair))).first()
            low, high = (None if r is None else (r["x"], r["k"]) for r in (low, high))
        else:
            n = self.axis.n()
            low, high = ((k, k) if 0 <= k < n else None for k in (min(math.floor(value), n - 1), max(math.ceil(value), 0)))
        if method == "nearest":
            both = [r for r in (high, low) if r is not None]
            found = min(both, key=lambda r: abs(r[0] - value), default=None)
        else:
            found = low if method in ("ffill", "pad") else high
        if found is None or (tolerance is not None and abs(found[0] - value) > tolerance):
            raise KeyError(f"no label of {self.axis.dim!r} is near {value!r}")
        return self.place(found[1]) if self.named else found[1]

    def beside(self, value: Any) -> tuple | None:
        """The labels on either side of a value, or the one that it is, each with its key; None beyond the ends."""
        if not self.named:
            low, high, n = math.floor(value), math.ceil(value), self.axis.n()
            order = self.axis.order()
            return ((low, order[low]), (high, order[high])) if 0 <= low and high < n else None
        pair = F.struct(self.label.alias("x"), self.key.alias("k"))
        low, high = self.frame.agg(F.max(F.when(self.label <= self._lit(value), pair)), F.min(F.when(self.label >= self._lit(value), pair))).first()
        return None if low is None or high is None else ((low["x"], low["k"]), (high["x"], high["k"]))

    def precision(self) -> timedelta:
        """The span of the finest unit that the labels use."""
        at, units = self.label.cast("timestamp_ntz"), (timedelta(0), timedelta(seconds=1), timedelta(minutes=1), timedelta(hours=1))
        uses = [F.max(at != F.date_trunc(unit, at).cast("timestamp_ntz")) for unit in ("second", "minute", "hour", "day")]
        return next((u for u, x in zip(units, self.frame.agg(*uses).first()) if x), timedelta(days=1))


def by_label(axis: Axis, value: Any, method: str | None = None, tolerance: Any = None) -> Any:
    """The positional index that a label index means on this axis. The driver sees counts, and a row for each label in a list."""
    own = Labels(axis)
    if isinstance(value, slice):
        lo, hi = (None if x is None else own.like(x, end) for x, end in ((value.start, False), (value.stop, True)))
        return Slice(0 if lo is None else own.below(lo, False), None if hi is None else own.below(hi, True), value.step)
    if isinstance(value, (list, tuple)):
        wanted = [own.like(x) for x in value]
        return Positions(tuple(own.find(wanted) if method is None else [own.near(x, method, tolerance) for x in wanted]))
    if own.dated and isinstance(value, str) and method is None:
        lo, hi = span(value)
        if hi - lo > own.precision():  # a part of a date, coarser than the labels, means all that fall in it
            found = Slice(own.below(lo, False), own.below(hi, True))
            if found.start == found.stop:
                raise KeyError(f"no label of {axis.dim!r} is in {value!r}")
            return found
    wanted = own.like(value)
    return Scalar(own.find([wanted])[0] if method is None else own.near(wanted, method, tolerance))
