"""A chain run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..model import Cube


def each_batch(to_cube: Callable[[DataFrame], Cube], chain: Callable[[Any], Any], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: makes a cube of a batch, runs the chain on it and hands its frame to the sink with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        sink(chain(to_cube(batch).plan).to_frame(), number)

    return run
