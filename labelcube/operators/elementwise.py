"""Functions of single cells."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Cube, Group, clean
from ..plans.steps import Elementwise


def run(cube: Cube, step: Elementwise) -> Cube:
    """On data variables only. Those that give a missing cell a value get a row for each first."""
    arg = lambda i, name, default=None: step.args[i] if len(step.args) > i else step.kwargs.get(name, default)

    def value(g: Group, v: str) -> Column:
        c, kind = F.col(f"`{v}`"), g.type_of(v)
        match step.name:
            case "fillna":
                return F.coalesce(c, F.lit(arg(0, "value")))
            case "astype":
                target = spark_name(arg(0, "dtype"))
                return clean(c.cast(target), T.DoubleType() if target in ("double", "float") else T.LongType())
            case "round":
                return F.bround(c, int(arg(0, "decimals", 0) or 0)) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
            case "clip":
                low, high = arg(0, "min"), arg(1, "max")
                out = c if high is None else F.least(c, F.lit(high))
                return F.when(c.isNotNull(), out if low is None else F.greatest(out, F.lit(low)))
            case "isnull":
                return c.isNull()
        return c.isNotNull()

    groups = []
    for g in cube.groups:
        if all(v in cube.coords for v in g.vars):
            groups.append(g)
            continue
        full = cube.densify(g) if step.name in ("fillna", "isnull", "notnull") else g
        groups.append(full.select({v: F.col(f"`{v}`") if v in cube.coords else value(full, v) for v in g.vars}))
    return replace(cube, groups=tuple(groups))


def spark_name(dtype: Any) -> str:
    kind = np.dtype(dtype) if not (isinstance(dtype, str) and dtype == "str") and dtype is not str else None
    if kind is None or kind.kind in "US":
        return "string"
    return {"f8": "double", "f4": "float", "i8": "bigint", "i4": "int", "i2": "smallint", "i1": "tinyint", "b1": "boolean", "u1": "smallint", "u2": "int", "u4": "bigint"}[f"{kind.kind}{kind.itemsize}"]
