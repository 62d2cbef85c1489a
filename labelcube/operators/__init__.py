"""Steps as DataFrame operations: one function for each kind."""

from __future__ import annotations

from ..model import Cube
from ..plans.steps import (
    Drop, Elementwise, GroupedReduce, Opaque, Project, Rechunk, Reduce, Rename, Scan, Select, Step, WeightedReduce, WindowedReduce,
)
from . import elementwise, grouped, opaque, reductions, scans, selection, variables, weighted, windowed

_RUN = {
    Reduce: reductions.run, Select: selection.run, Project: variables.project, Drop: variables.drop, Rename: variables.rename, Rechunk: variables.rechunk,
    Scan: scans.run, Elementwise: elementwise.run, GroupedReduce: grouped.run, WindowedReduce: windowed.run, WeightedReduce: weighted.run,
}


def execute(cube: Cube, steps: list[Step]) -> Cube:
    """Run a paired plan; an opaque opener takes the call after it along."""
    at = 0
    while at < len(steps):
        step = steps[at]
        if isinstance(step, Opaque):
            cube, used = opaque.run(cube, step, steps[at + 1] if at + 1 < len(steps) else None)
            at += used
        else:
            cube = _RUN[type(step)](cube, step)
            at += 1
    return cube
