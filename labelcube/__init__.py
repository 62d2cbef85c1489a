"""Labelled multi-dimensional data on Spark: deferred, checked and rewritten chains over DataFrames."""

from .errors import InvalidExpressionError, UnsupportedError
from .model import Cube, SmallArray

__all__ = ["Cube", "InvalidExpressionError", "SmallArray", "UnsupportedError"]
