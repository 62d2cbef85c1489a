"""Reductions as Spark aggregates. A missing cell is a null or an absent row; NaN never enters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Value of a reduction over no cells at all, where it has one.
IDENTITY = {"sum": 0, "prod": 1.0, "count": 0, "all": True, "any": False}


def number(v: Column, kind: T.DataType) -> Column:
    return v.cast("long") if isinstance(kind, T.BooleanType) else v


def truth(v: Column, kind: T.DataType) -> Column:
    return v if isinstance(kind, T.BooleanType) else v != F.lit("") if isinstance(kind, T.StringType) else v != 0


def aggregate(op: str, v: Column, kind: T.DataType, cells: Column | None = None, over: Callable[[Column], Column] = lambda c: c,
              ddof: int = 0, skipna: bool = True, min_count: int | None = None) -> Column:
    """The reduction op of v. cells: how many cells there are with the missing ones; over: puts an aggregate on a window."""
    present = over(F.count(v))
    own = number(v, kind)
    if op == "count":
        return present
    if op == "all":  # a missing cell is not zero, so it is true
        return F.coalesce(over(F.bool_and(truth(v, kind))), F.lit(True))
    if op == "any":
        found = F.coalesce(over(F.bool_or(truth(v, kind))), F.lit(False))
        return found if cells is None else found | (present < cells)
    if op in ("sum", "prod"):
        zero = F.lit(IDENTITY[op]).cast("double" if op == "prod" or isinstance(kind, (T.DoubleType, T.FloatType)) else "long")
        out = F.coalesce(over(F.sum(own) if op == "sum" else F.product(own.cast("double"))), zero)
        if min_count:
            out = F.when(present >= min_count, out)
    elif op in ("std", "var"):
        pop, samp = (F.stddev_pop, F.stddev_samp) if op == "std" else (F.var_pop, F.var_samp)
        if ddof == 0:
            out = over(pop(own))
        elif ddof == 1:
            out = F.when(present > 1, over(samp(own)))
        else:
            out = F.try_divide(over(F.var_pop(own)) * present, F.greatest(present - ddof, F.lit(0)))
            out = F.sqrt(out) if op == "std" else out
    else:
        out = over({"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}[op](own if op != "min" and op != "max" else v))
    if not skipna and cells is not None:
        out = F.when(present == cells, out)
    return out


def alone(op: str, v: Column, kind: T.DataType) -> Column:
    """The reduction of one cell over no dimension: itself, but for what a reduction does to a missing one."""
    own = number(v, kind)
    match op:
        case "count":
            return v.isNotNull().cast("long")
        case "all" | "any":
            return F.coalesce(truth(v, kind), F.lit(True))
        case "sum":
            return F.coalesce(own, F.lit(0).cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long"))
        case "prod":
            return F.coalesce(own.cast("double"), F.lit(1.0))
        case "std" | "var":
            return F.when(v.isNotNull(), F.lit(0.0))
        case "mean" | "median":
            return own.cast("double")
    return v


def windowed(op: str, v: Column, kind: T.DataType, frame: Window, least: int, ddof: int = 0) -> Column:
    """op over a frame with at least `least` cells present; null elsewhere."""
    over = lambda c: c.over(frame)
    present = over(F.count(v))
    if op == "median":  # no frame takes median itself
        held = F.sort_array(over(F.collect_list(v)))
        n = F.size(held)
        low, high = F.get(held, F.floor((n - 1) / 2).cast("int")), F.get(held, F.floor(n / 2).cast("int"))
        out = (low + high) / 2
    else:
        out = aggregate(op, v, kind, over=over, ddof=ddof)
    return out if op == "count" and least <= 0 else F.when(present >= least, out)
