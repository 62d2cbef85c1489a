"""The deferred chain: records calls, shows or runs them rewritten."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..model import Cube, key
from .pairing import pair
from .render import Explanation, format_plan
from .rules import rewrite
from .steps import ELEMENTWISE, OPENERS, REDUCTIONS, SCANS, Opaque, Opener, Step, step_of

_METHODS = {*REDUCTIONS, *SCANS, *ELEMENTWISE, *OPENERS, "reduce", "isel", "sel", "chunk", "rename", "drop_vars"}
#: Calls that only mean something after an opener.
_CLOSERS = {"construct", "sum_of_weights", "sum_of_squares"}
#: Ends of a chain, which read data or write it.
TERMINALS = (
    "to_frame", "to_dataframe", "to_dask_dataframe", "to_pandas", "to_series", "to_array", "to_dataarray", "to_numpy", "to_dict", "to_stacked_array", "to_index",
    "to_masked_array", "to_netcdf", "to_zarr", "to_parquet", "plot", "values",
)
_FACTS = ("dims", "sizes", "coords", "data_vars")


class Plan:
    """An immutable list of steps over a cube; each call gives a new one. Nothing is read before an end of the chain."""

    def __init__(self, base: Cube, steps: tuple[Step, ...] = ()):
        object.__setattr__(self, "_base", base)
        object.__setattr__(self, "_steps", steps)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("a plan doesn't change; its calls give new ones")

    def __repr__(self) -> str:
        return f"<Plan of {len(self._steps)} calls: {', '.join(s.name for s in self._steps)}>"

    def _then(self, name: str, args: tuple, kwargs: dict) -> Plan:
        open_ = bool(self._steps) and isinstance(self._steps[-1], Opener)
        if name == "__getitem__" and (open_ or any(isinstance(s, Opaque) for s in self._steps)):
            step: Step = Opaque(name, args, kwargs)
        else:
            step = step_of(name, args, kwargs, array=self._array())
        return Plan(self._base, (*self._steps, step))

    def _array(self) -> bool:
        """Whether the last step leaves an array, whose [] is by position."""
        from .steps import Project

        array = self._base.array
        for s in self._steps:
            if isinstance(s, Project):
                array = s.single
        return array

    def __getitem__(self, item: Any) -> Plan:
        return self._then("__getitem__", (item,), {})

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TERMINALS:
            result = Result(self.collect())
            return getattr(result, name)
        if name in _FACTS:
            cube = self.collect()
            return tuple(sorted(map(str, cube.shape.coords))) if name == "coords" else getattr(cube, name)
        from ..operators.opaque import CALLS

        open_ = bool(self._steps) and isinstance(self._steps[-1], Opener)
        if name in _METHODS or name in CALLS or name in _CLOSERS and open_:
            return self._recorder(name)
        raise AttributeError(f"a cube has no {name!r}")

    def _recorder(self, name: str) -> Callable[..., Plan]:
        def record(*args: Any, **kwargs: Any) -> Plan:
            return self._then(name, args, kwargs)

        record.__name__ = name
        return record

    def optimized(self) -> list[Step]:
        """The steps that will run: paired, checked and rewritten."""
        shape = self._base.shape
        return rewrite(pair(list(self._steps), shape), shape)

    def collect(self, optimize: bool = True) -> Cube:
        """The cube that the chain makes: its DataFrames, which Spark runs when a result is asked for."""
        from ..operators import execute

        steps = self.optimized() if optimize else pair(list(self._steps), self._base.shape)
        return execute(self._base, steps)

    compute = collect

    def explain(self) -> Explanation:
        """The rewritten plan as text; nothing runs."""
        return Explanation(format_plan(self.optimized()))


class Result:
    """The ends of a chain."""

    def __init__(self, cube: Cube):
        self.cube = cube

    def to_frame(self, coords: bool = True) -> DataFrame:
        """A Spark DataFrame, a row a cell."""
        return self.cube.to_frame(coords)

    def to_dataframe(self) -> DataFrame:
        return self.cube.to_frame()

    def to_dask_dataframe(self) -> DataFrame:
        """The distributed frame: Spark's."""
        return self.cube.to_frame()

    def to_pandas(self) -> Any:
        """Indexed by the dimensions' labels, in order."""
        cube = self.cube
        pdf = cube.to_frame().toPandas()
        dims = [d for d in cube.dims if d in pdf.columns]
        pdf = pdf.set_index(dims).sort_index() if dims else pdf
        return pdf[cube.data_vars[0]] if cube.array and dims else pdf

    def to_series(self) -> Any:
        pdf = self.to_pandas()
        return pdf if not hasattr(pdf, "columns") else pdf[self._name()]

    def _name(self) -> str:
        names = self.cube.data_vars
        if len(names) != 1:
            raise UnsupportedError(f"of one variable, not of {list(names)}; pick one by [name]")
        return names[0]

    def to_numpy(self, name: str | None = None) -> np.ndarray:
        """The variable's cells in order of positions; missing ones are NaN where the type has it."""
        cube = self.cube
        g = cube.group_of(name or self._name())
        name = name or self._name()
        axes = [cube.axes[d].known() for d in g.dims]
        shape = tuple(a.n() for a in axes)
        rows = g.df.select(*(f"`{k}`" for k in g.keys()), f"`{name}`").toPandas()
        kind = g.type_of(name).typeName()
        missing = len(rows) < int(np.prod(shape, dtype=int)) or bool(rows[name].isna().any())
        dtype: Any = object if kind in ("string", "timestamp_ntz", "timestamp") or (missing and kind == "boolean") else float if missing or kind in ("double", "float") else {"boolean": bool}.get(kind, np.int64)
        out = np.full(shape, np.nan if dtype is float else None if dtype is object else 0, dtype)
        at = []
        for a in axes:
            where = {b: i for i, b in enumerate(a.order())} if a.at is not None else None
            keys = rows[key(a.dim)].astype(int)
            at.append(keys.map(where).to_numpy(int) if where is not None else keys.to_numpy(int))
        values = rows[name].to_numpy(dtype, na_value=np.nan) if dtype is float else rows[name].to_numpy(dtype)
        if not axes:
            return np.asarray(values[0] if len(values) else out)
        out[tuple(at)] = values
        return out

    @property
    def values(self) -> np.ndarray:
        return self.to_numpy()

    def to_masked_array(self) -> Any:
        values = self.to_numpy()
        mask = np.equal(values, None) if values.dtype == object else np.isnan(values) if values.dtype.kind == "f" else np.zeros(values.shape, bool)
        return np.ma.masked_array(values, mask)

    def to_dict(self) -> dict:
        from ..operators.selection import labels

        cube = self.cube
        return {
            "dims": {d: a.n() for d, a in cube.axes.items()},
            "coords": {c: {"dims": (d,), "data": labels(a) if c == d else [r[0] for r in a.frame().orderBy(f"`{key(d)}`").select(f"`{c}`").collect()]} for d, a in cube.axes.items() for c in a.coords}
            | {c: {"dims": (), "data": s.first()[0]} for c, s in cube.scalars.items()},
            "data_vars": {v: {"dims": cube.group_of(v).dims, "data": self.to_numpy(v).tolist()} for v in cube.data_vars},
        }

    def to_array(self, dim: str = "variable", name: str | None = None) -> DataFrame:
        """Variables as a dimension: a row for each cell of each."""
        cube, name = self.cube, name or "value"
        df = cube.to_frame()
        rest = [c for c in df.columns if c not in cube.data_vars]
        pairs = F.explode(F.array(*(F.struct(F.lit(v).alias(dim), F.col(f"`{v}`").cast("double").alias(name)) for v in cube.data_vars)))
        return df.select(*(f"`{c}`" for c in rest), pairs.alias("@pair")).select(f"`@pair`.`{dim}`", *(f"`{c}`" for c in rest), f"`@pair`.`{name}`")

    to_dataarray = to_array

    def to_stacked_array(self, new_dim: str, sample_dims: Any, variable_dim: str = "variable", name: str | None = None) -> DataFrame:
        """Variables and their other dimensions stacked into one: a struct of them."""
        cube, sample = self.cube, [sample_dims] if isinstance(sample_dims, str) else list(sample_dims)
        out = None
        for g in cube.merged():
            if missing := [d for d in sample if d not in g.dims]:
                raise ValueError(f"{g.vars} have no dimension {missing}")
            others = [d for d in cube.dims if d not in sample]
            part = Cube(cube.spark, {d: cube.axes[d] for d in g.dims}, (g,), cube.coords).to_frame(coords=False)
            for v in g.vars:
                if v in cube.coords:
                    continue
                place = F.struct(F.lit(v).alias(variable_dim), *((F.col(f"`{d}`") if d in g.dims else F.lit(None)).cast("string").alias(d) for d in others))
                one = part.select(*(f"`{d}`" for d in sample), place.alias(new_dim), F.col(f"`{v}`").cast("double").alias(name or "value"))
                out = one if out is None else out.unionByName(one)
        return out

    def to_index(self) -> Any:
        import pandas as pd

        from ..operators.selection import labels

        dims = self.cube.dims
        if len(dims) != 1:
            raise UnsupportedError("an index is of one dimension")
        return pd.Index(labels(self.cube.axes[dims[0]]), name=dims[0])

    def to_parquet(self, path: str) -> None:
        """Write the cube, dealt out as chunk() said; Cube.open(spark, path) reads it."""
        self.cube.write(path)

    def to_netcdf(self, *_: Any, **__: Any) -> None:
        raise UnsupportedError("Spark writes no NetCDF; to_parquet(path) writes the cells and axes")

    def to_zarr(self, *_: Any, **__: Any) -> None:
        raise UnsupportedError("Spark writes no Zarr; to_parquet(path) writes the cells and axes")

    @property
    def plot(self) -> Any:
        return self.to_pandas().plot
