"""How one dimension is addressed by a selection, and cut by a chunking."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np


@dataclass(frozen=True)
class Scalar:
    """One position or label: the only index that takes its dimension away."""

    value: Any

    def size(self, n: int | None) -> int | None:
        return None


@dataclass(frozen=True)
class Slice:
    """A positional slice. It is forward if no bound counts from the end and the step is 1 or more."""

    start: int | None
    stop: int | None
    step: int | None = None

    @property
    def forward(self) -> bool:
        return (self.start or 0) >= 0 and (self.stop is None or self.stop >= 0) and (self.step is None or self.step >= 1)

    def raw(self) -> slice:
        return slice(self.start, self.stop, self.step)

    def size(self, n: int | None) -> int | None:
        return None if n is None else len(range(*self.raw().indices(n)))


@dataclass(frozen=True)
class Positions:
    """Positions in the order given, repeats included; a mask is the positions where it holds."""

    values: tuple[int, ...]

    def size(self, n: int | None) -> int | None:
        return len(self.values)


@dataclass(frozen=True)
class Label:
    """A label, a slice of labels (both ends included) or several labels."""

    value: Any

    @property
    def single(self) -> bool:
        return not isinstance(self.value, (slice, list, tuple, np.ndarray))

    def size(self, n: int | None) -> int | None:
        return None if isinstance(self.value, slice) or self.single else len(self.value)


@dataclass(frozen=True)
class Pointwise:
    """An array along dimensions of its own: it takes the indexed dimension's place by its own."""

    value: Any

    def size(self, n: int | None) -> int | None:
        return None


def classify_index(dim: str, value: Any, by_label: bool) -> Scalar | Slice | Positions | Label | Pointwise:
    """What kind of index a value is; every value is one."""
    from ..model import SmallArray

    if isinstance(value, SmallArray):
        if value.dims == (dim,) or value.dims == ():
            value = value.values.tolist()
        else:
            return Pointwise(value)
    if isinstance(value, np.ndarray):
        value = value.item() if value.ndim == 0 else value.tolist()
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, (list, tuple)):
        value = [x.item() if isinstance(x, np.generic) else x for x in value]
        if value and all(isinstance(x, bool) for x in value):  # bool is an int, so this comes first
            return Positions(tuple(i for i, x in enumerate(value) if x))
        if not by_label and all(isinstance(x, int) for x in value):
            return Positions(tuple(value))
        return Label(value)
    if isinstance(value, slice):
        if by_label:
            return Label(value)
        bounds = [None if x is None else int(x) for x in (value.start, value.stop, value.step)]
        return Slice(*bounds)
    if by_label:
        return Label(value)
    return Scalar(int(value)) if isinstance(value, int) else Label(value)


def drops(spec: Any) -> bool:
    return isinstance(spec, Scalar) or (isinstance(spec, Label) and spec.single)


def compose(outer: Any, inner: Any) -> Any | None:
    """The one index that does what outer and then inner do, without knowing the size; None if that can't be said."""
    if isinstance(outer, Slice) and outer.forward:
        first, step = outer.start or 0, outer.step or 1
        if isinstance(inner, Slice) and inner.forward:
            ends = [outer.stop] + ([first + inner.stop * step] if inner.stop is not None else [])
            ends = [e for e in ends if e is not None]
            return Slice(first + (inner.start or 0) * step, min(ends) if ends else None, step * (inner.step or 1))
        wanted = (inner.value,) if isinstance(inner, Scalar) else inner.values if isinstance(inner, Positions) else None
        if wanted is None or any(k < 0 or (outer.stop is not None and first + k * step >= outer.stop) for k in wanted):
            return None
        moved = tuple(first + k * step for k in wanted)
        return Scalar(moved[0]) if isinstance(inner, Scalar) else Positions(moved)
    if isinstance(outer, Positions):
        n = len(outer.values)
        if isinstance(inner, Slice):
            return Positions(outer.values[inner.raw()])
        wanted = (inner.value,) if isinstance(inner, Scalar) else inner.values if isinstance(inner, Positions) else None
        if wanted is None or any(not -n <= k < n for k in wanted):
            return None
        return Scalar(outer.values[wanted[0]]) if isinstance(inner, Scalar) else Positions(tuple(outer.values[k] for k in wanted))
    return None


def raw_index(spec: Any) -> Any:
    """The value that a call would be written with."""
    if isinstance(spec, Slice):
        return spec.raw()
    return list(spec.values) if isinstance(spec, Positions) else spec.value


@dataclass(frozen=True)
class Chunk:
    """A chunk size along a dimension: kind is size, whole, same, auto, bytes, blocks or odd."""

    kind: str
    value: Any

    @property
    def crossable(self) -> bool:
        """Whether a selection may come first: only where the cut doesn't depend on how long the dimension is."""
        return self.kind in ("size", "whole", "same")


def classify_chunk(value: Any) -> Chunk:
    if value is None:
        return Chunk("same", None)
    if isinstance(value, np.integer):
        value = int(value)
    if isinstance(value, bool):
        return Chunk("odd", value)
    if isinstance(value, int):
        return Chunk("whole", -1) if value == -1 else Chunk("size", value) if value >= 1 else Chunk("odd", value)
    if isinstance(value, str):
        return Chunk("auto" if value == "auto" else "bytes", value)
    if isinstance(value, (list, tuple)) and all(isinstance(x, int) and not isinstance(x, bool) for x in value):
        return Chunk("blocks", tuple(value))
    return Chunk("odd", value)
