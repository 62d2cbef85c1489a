"""Cubes: named variables over named dimensions, as DataFrames of cells keyed by integer positions.

A cell's key columns, "@dim", hold base positions, which no selection renumbers: a selection changes the axis, on the driver,
and adds a predicate on the key, which reaches the scan. Variables over the same dimensions share a DataFrame. Labels
and other coordinates of one dimension lie in a table of its axis. An absent row is a missing cell.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.shape import Shape

#: Positions beyond which a list of them is joined instead of written into a predicate, and cells that a small array may have.
LISTED, SMALL = 1000, 5_000_000


def key(dim: str) -> str:
    return f"@{dim}"


class SmallArray:
    """A labelled array on the driver, for weights and indexes: of at most SMALL cells."""

    def __init__(self, values: Any, dims: Sequence[str] | str = (), coords: Mapping[str, Sequence] | None = None, name: str | None = None):
        self.values = np.asarray(values)
        self.dims = (dims,) if isinstance(dims, str) else tuple(dims)
        if self.values.ndim != len(self.dims) or self.values.size > SMALL:
            raise ValueError(f"{len(self.dims)} dimensions named for an array of shape {self.values.shape}" if self.values.size <= SMALL else f"over {SMALL} cells")
        self.coords, self.name = {d: list(v) for d, v in (coords or {}).items()}, name

    def __repr__(self) -> str:
        return f"<SmallArray {dict(zip(self.dims, self.values.shape))}>\n{self.values!r}"


@dataclass(frozen=True)
class Axis:
    """A dimension: its table (key and coordinates by base position), its size if known, and which base positions it holds, in order.

    at: None if all of them in order, else a range or a strictly increasing tuple.
    """

    dim: str
    table: DataFrame | None
    coords: tuple[str, ...] = ()
    size: int | None = None
    at: range | tuple[int, ...] | None = None

    def n(self) -> int:
        """The size; counts the axis's own table if it isn't known."""
        if self.size is not None:
            return self.size
        return self.frame().count()

    def known(self) -> Axis:
        return self if self.size is not None else replace(self, size=self.n())

    def order(self) -> range | tuple[int, ...]:
        return self.at if self.at is not None else range(self.n())

    def frame(self) -> DataFrame:
        """Its positions with their coordinates."""
        if self.table is not None:
            return self.keep(self.table)
        spark = SparkSession.getActiveSession()
        if self.at is None or isinstance(self.at, range):
            at = self.at if self.at is not None else range(self.n())
            return spark.range(at.start, at.stop, at.step).select(F.col("id").alias(key(self.dim))) if len(at) else spark.range(0).select(F.col("id").alias(key(self.dim)))
        return spark.createDataFrame([(int(i),) for i in self.at], f"`{key(self.dim)}` long")

    def keep(self, cells: DataFrame) -> DataFrame:
        """The rows of cells whose position the axis holds."""
        k = F.col(f"`{key(self.dim)}`")
        if self.at is None:
            return cells
        if not len(self.at):
            return cells.where(F.lit(False))
        if isinstance(self.at, range):
            out = cells.where((k >= self.at[0]) & (k <= self.at[-1]))
            return out.where((k - self.at[0]) % self.at.step == 0) if self.at.step > 1 else out
        if len(self.at) <= LISTED:
            return cells.where(k.isin(*self.at))
        wanted = cells.sparkSession.createDataFrame([(int(i),) for i in self.at], f"`{key(self.dim)}` long")
        return cells.join(wanted, key(self.dim), "left_semi")

    def place(self) -> Column | None:
        """The current position as an expression of the key; None where it takes a table."""
        k = F.col(f"`{key(self.dim)}`")
        if self.at is None:
            return k
        if isinstance(self.at, range):
            return ((k - (self.at[0] if len(self.at) else 0)) / self.at.step).cast("long") if self.at.step != 1 else k - (self.at[0] if len(self.at) else 0)
        return None


@dataclass(frozen=True)
class Group:
    """The variables over one set of dimensions. dense: every cell of the grid has a row."""

    df: DataFrame
    dims: tuple[str, ...]
    vars: tuple[str, ...]
    dense: bool = False

    def keys(self, without: Iterable[str] = ()) -> list[str]:
        return [key(d) for d in self.dims if d not in set(without)]

    def type_of(self, v: str) -> T.DataType:
        return self.df.schema[v].dataType

    def select(self, values: Mapping[str, Column], dense: bool | None = None) -> Group:
        return replace(self, df=self.df.select(*(f"`{k}`" for k in self.keys()), *(c.alias(v) for v, c in values.items())), vars=tuple(values), dense=self.dense if dense is None else dense)


@dataclass(frozen=True)
class Cube:
    """Variables, axes and coordinates. Each method of a chain goes through .plan; what collect() returns is another Cube."""

    spark: SparkSession
    axes: Mapping[str, Axis]
    groups: tuple[Group, ...]
    coords: frozenset = frozenset()  # variables in groups that are coordinates
    scalars: Mapping[str, DataFrame] = field(default_factory=dict)  # coordinates without a dimension: one row, one column
    array: bool = False
    chunks: Mapping[str, Any] = field(default_factory=dict)

    # What is known without data

    @property
    def data_vars(self) -> tuple[str, ...]:
        return tuple(v for g in self.groups for v in g.vars if v not in self.coords)

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([d for g in self.groups for d in g.dims] + list(self.axes)))

    @property
    def sizes(self) -> dict[str, int | None]:
        return {d: a.size for d, a in self.axes.items()}

    @property
    def shape(self) -> Shape:
        variables = {c: (d,) for d, a in self.axes.items() for c in a.coords}
        variables |= {v: g.dims for g in self.groups for v in g.vars} | {c: () for c in self.scalars}
        coords = self.coords | {c for a in self.axes.values() for c in a.coords} | set(self.scalars)
        return Shape(variables, frozenset(c for c in coords if c in variables), self.sizes, self.array)

    @property
    def plan(self) -> Any:
        from .plans.recorder import Plan

        return Plan(self)

    def group_of(self, v: str) -> Group:
        for g in self.groups:
            if v in g.vars:
                return g
        raise KeyError(v)

    def axis_of(self, coordinate: str) -> Axis | None:
        return next((a for a in self.axes.values() if coordinate in a.coords), None)

    # Making

    @classmethod
    def from_frame(cls, df: DataFrame, dims: Sequence[str], variables: Sequence[str], coords: Mapping[str, Sequence[str]] | None = None, dense: bool = False, labels: Mapping[str, DataFrame] | None = None) -> Cube:
        """Cells in long form, a column for each dimension's labels, unique together, and one for each variable.

        coords names, by dimension, further columns that follow from its label. An axis is the labels that occur, in order; it is numbered from
        that small table alone. labels gives an axis's table (label and coords, one row a label) where there is one, which saves reading the
        cells for it; cells with other labels are left out; a column "@dim" in it is the numbering, for axes too long to sort in one task. NaN becomes null. Over large tables, write the cube once and open() it.
        """
        axes, cells, given = {}, df, labels or {}
        for d in dims:
            own = list((coords or {}).get(d, ()))
            labels = given[d] if d in given else df.groupBy(d).agg(*[F.any_value(c, True).alias(c) for c in own]) if own else df.select(d).distinct()
            labels = labels.where(F.col(f"`{d}`").isNotNull())
            if key(d) not in labels.columns:  # one sorted window, over distinct labels
                labels = labels.withColumn(key(d), F.row_number().over(Window.orderBy(f"`{d}`")).cast("long") - 1)
            axes[d] = Axis(d, labels, (d, *own))
            cells = cells.join(labels.select(f"`{d}`", f"`{key(d)}`"), d)
        values = {v: clean(F.col(f"`{v}`"), df.schema[v].dataType) for v in variables}
        cells = cells.select(*(f"`{key(d)}`" for d in dims), *(c.alias(v) for v, c in values.items()))
        return cls(df.sparkSession, axes, (Group(cells, tuple(dims), tuple(variables), dense),))

    @classmethod
    def from_arrays(cls, spark: SparkSession, data: Mapping[str, tuple[Sequence[str], Any]], coords: Mapping[str, Any] | None = None) -> Cube:
        """Small arrays, as name: (dims, values); a coordinate is values along a dimension of its name, or (dims, values)."""
        given = {c: (v if isinstance(v, tuple) else ((c,), v)) for c, v in (coords or {}).items()}
        arrays = {n: ((d,) if isinstance(d, str) else tuple(d), np.asarray(v)) for n, (d, v) in {**data, **given}.items()}
        sizes: dict[str, int] = {}
        for n, (d, v) in arrays.items():
            for dim, size in zip(d, v.shape, strict=True):
                if sizes.setdefault(dim, size) != size:
                    raise ValueError(f"{dim} has sizes {sizes[dim]} and {size}")
        axes = {}
        for dim, size in sizes.items():
            own = [c for c in given if arrays[c][0] == (dim,)]
            rows = [(i, *(_python(arrays[c][1][i]) for c in own)) for i in range(size)]
            shape = T.StructType([T.StructField(key(dim), T.LongType()), *(T.StructField(c, spark_type(arrays[c][1])) for c in own)])
            axes[dim] = Axis(dim, spark.createDataFrame(rows, shape), tuple(sorted(own, key=lambda c: c != dim)), size)
        groups: dict[tuple, list[str]] = {}
        for n, (d, _) in arrays.items():
            if n in data or len(d) != 1:
                groups.setdefault(d, []).append(n)
        made, scalars = [], {}
        for d, names in groups.items():
            at = np.indices([sizes[x] for x in d]).reshape(len(d), -1).T.tolist() if d else [[]]
            rows = [(*p, *(_python(arrays[n][1][tuple(p)]) for n in names)) for p in at]
            shape = T.StructType([*(T.StructField(key(x), T.LongType()) for x in d), *(T.StructField(n, spark_type(arrays[n][1])) for n in names)])
            df = spark.createDataFrame(rows, shape)
            for n in names if not d else ():
                if n in given:
                    scalars[n] = df.select(n)
            left = tuple(n for n in names if n not in scalars)
            if left:
                made.append(Group(df.select(*(f"`{key(x)}`" for x in d), *(f"`{n}`" for n in left)), d, left, True))
        return cls(spark, axes, tuple(made), frozenset(c for c in given if len(arrays[c][0]) > 1), scalars)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Cube:
        """A cube that to_parquet wrote. Selections reach the scans of its cells, and unused variables aren't read."""
        axes, groups, about = {}, [], spark.read.parquet(f"{path}/about").collect()  # a row an axis and a set of dimensions
        for r in about:
            frame = spark.read.parquet(f"{path}/{r['name']}")
            if r["kind"] == "axis":
                axes[r["dims"][0]] = Axis(r["dims"][0], frame, tuple(r["vars"]), r["size"])
            else:
                groups.append(Group(frame, tuple(r["dims"]), tuple(r["vars"]), r["dense"]))
        return cls(spark, axes, tuple(groups), frozenset(c for r in about for c in r["coords"]))

    def write(self, path: str) -> None:
        """A table for each set of dimensions, dealt out and sorted by its keys, and one for each axis, numbered from 0."""
        from .operators.variables import partitioned
        from .operators.windowed import in_place

        cube = self
        for d in self.axes:
            cube = in_place(cube, d)
        about = []
        for g in partitioned(cube).merged():
            name = "_".join(("cells", *map(str, g.dims)))
            df = g.df.sortWithinPartitions(*(f"`{k}`" for k in g.keys())) if g.dims else g.df
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            about.append(("cells", name, list(g.dims), list(g.vars), [v for v in g.vars if v in cube.coords], None, g.dense))
        for d, a in cube.axes.items():
            a = a.known()
            a.frame().write.mode("overwrite").parquet(f"{path}/axis_{d}")
            about.append(("axis", f"axis_{d}", [d], list(a.coords), [], a.size, True))
        shape = "kind string, name string, dims array<string>, vars array<string>, coords array<string>, size long, dense boolean"
        self.spark.createDataFrame(about, shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    # Grids

    def grid(self, dims: Sequence[str]) -> DataFrame:
        """Every cell of the dimensions: as large as a dense result over them."""
        frames = [self.axes[d].frame().select(f"`{key(d)}`") for d in dims]
        return reduce(lambda a, b: a.crossJoin(b), frames) if frames else self.spark.range(1).select()

    def densify(self, g: Group) -> Group:
        if g.dense or not g.dims:
            return g
        return replace(g, df=self.grid(g.dims).join(g.df, g.keys(), "left"), dense=True)

    def merged(self) -> tuple[Group, ...]:
        """Groups over the same dimensions become one."""
        by: dict[frozenset, list[Group]] = {}
        for g in self.groups:
            by.setdefault(frozenset(g.dims), []).append(g)
        out = []
        for own in by.values():
            first = own[0]
            for g in own[1:]:
                df = first.df.join(g.df, first.keys(), "full_outer") if first.dims else first.df.crossJoin(g.df)
                first = Group(df, first.dims, first.vars + g.vars, first.dense or g.dense)
            out.append(first)
        return tuple(out)

    # Results

    def to_frame(self, coords: bool = True) -> DataFrame:
        """One row a cell, with a column for each dimension (its label, or its position if it has none), coordinate and variable.

        Variables over fewer dimensions are repeated along the others. Cells that no variable has a row for stay absent.
        """
        groups = self.merged()
        if not groups:
            out = self.grid(list(self.axes))
            dims: tuple[str, ...] = tuple(self.axes)
        else:
            groups = tuple(sorted(groups, key=lambda g: -len(g.dims)))
            out, dims = groups[0].df, groups[0].dims
            for g in groups[1:]:
                shared = [key(d) for d in g.dims if d in dims]
                df = F.broadcast(g.df) if not g.dims else g.df
                new = [d for d in g.dims if d not in dims]
                out = out.join(df, shared, "full_outer" if new else "left") if shared else out.crossJoin(df)
                dims = (*dims, *new)
        columns: list[Column] = []
        for d in dims:
            axis = self.axes[d]
            if axis.table is not None and axis.coords:
                names = [c for c in axis.coords if coords or c == d]
                table = axis.frame().select(f"`{key(d)}`", *(F.col(f"`{c}`").alias(f"#{c}") for c in names))
                out = out.join(table, key(d))
                columns += [F.col(f"`#{c}`").alias(c) for c in names]
            if d not in axis.coords:
                place = axis.place()
                columns.append((F.col(f"`{key(d)}`") if place is None else place).alias(d))
        for c, one in self.scalars.items() if coords else ():
            out = out.crossJoin(F.broadcast(one.select(F.col(f"`{c}`").alias(f"#{c}"))))
            columns.append(F.col(f"`#{c}`").alias(c))
        seen = self.coords if not coords else frozenset()
        return out.select(*columns, *(f"`{v}`" for g in groups for v in g.vars if v not in seen))


def clean(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def _python(x: Any) -> Any:
    if isinstance(x, np.datetime64):
        return x.astype("datetime64[us]").item()
    x = x.item() if isinstance(x, np.generic) else x
    return None if isinstance(x, float) and x != x else x


def spark_type(values: np.ndarray) -> T.DataType:
    match values.dtype.kind:
        case "f":
            return T.FloatType() if values.dtype.itemsize == 4 else T.DoubleType()
        case "i" | "u":
            return T.LongType()
        case "b":
            return T.BooleanType()
        case "M":
            return T.TimestampNTZType()
    return T.StringType()
