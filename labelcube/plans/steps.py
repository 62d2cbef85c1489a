"""The kinds of step that a plan is a list of."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Dims:
    """Dimensions by name, or every one that there is."""

    names: frozenset = frozenset()
    every: bool = False

    def among(self, known: frozenset) -> frozenset:
        return known if self.every else self.names


EVERY = Dims(every=True)


@dataclass(frozen=True, eq=False)
class Step:
    """One call, or the two calls of a pair: what was said."""

    name: str
    args: tuple = ()
    kwargs: Mapping[str, Any] = field(default_factory=dict)

    def with_(self, **changes: Any) -> Step:
        return replace(self, **changes)

    def yields_to(self, index: frozenset, shape: Any) -> bool:
        """Whether a selection along these dimensions gives the same before this step as after it. shape is the one before it, if known."""
        return False

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        """Whether this step does the same to variables that span these dimensions when all others have been left out before it."""
        return False

    def ended(self, shape: Any) -> frozenset:
        """Dimensions that no later step can name."""
        return frozenset()


def _all(spans: list[frozenset]) -> frozenset:
    return frozenset().union(*spans)


class _Along(Step):
    """A step that works along its dims, cell by cell of all the others."""

    def along(self, shape: Any) -> frozenset | None:
        """The dimensions, None where they are all that a shape has that isn't known."""
        if shape is None:
            return None if self.dims.every else self.dims.names
        return self.dims.among(shape.dims)

    def yields_to(self, index: frozenset, shape: Any) -> bool:
        own = self.along(shape)
        return own is not None and own.isdisjoint(index)

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        own = self.along(shape)
        return own is not None and own <= _all(spans)


@dataclass(frozen=True, eq=False)
class Reduce(_Along):
    dims: Dims = EVERY
    keepdims: bool = False

    def ended(self, shape: Any) -> frozenset:
        return frozenset() if self.keepdims else self.along(shape) or frozenset()


@dataclass(frozen=True, eq=False)
class Select(Step):
    index: Mapping[str, Any] = field(default_factory=dict)
    options: Mapping[str, Any] = field(default_factory=dict)

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        return _all(spans).issuperset(self.index)


@dataclass(frozen=True, eq=False)
class Project(Step):
    key: Any = None

    @property
    def single(self) -> bool:
        return not isinstance(self.key, list)

    @property
    def names(self) -> list:
        return [self.key] if self.single else self.key


@dataclass(frozen=True, eq=False)
class Drop(Step):
    names: tuple = ()

    def yields_to(self, index: frozenset, shape: Any) -> bool:
        return True


@dataclass(frozen=True, eq=False)
class Rename(Step):
    mapping: Mapping[Any, Any] = field(default_factory=dict)

    def yields_to(self, index: frozenset, shape: Any) -> bool:
        return index.isdisjoint(self.mapping.values())


@dataclass(frozen=True, eq=False)
class Scan(_Along):
    dims: Dims = EVERY


@dataclass(frozen=True, eq=False)
class Elementwise(Step):
    def yields_to(self, index: frozenset, shape: Any) -> bool:
        return True

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        return True


@dataclass(frozen=True, eq=False)
class Rechunk(Step):
    chunks: Mapping[str, Any] = field(default_factory=dict)
    uniform: Any = None
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True, eq=False)
class Opaque(Step):
    """What no rule knows: nothing crosses it."""


@dataclass(frozen=True, eq=False)
class Opener(Step):
    """The first call of a pair, such as groupby; none is left after pairing."""


@dataclass(frozen=True, eq=False)
class Paired(Step):
    """An opener and the reduction that closes it."""

    closer: Step = None  # type: ignore[assignment]


@dataclass(frozen=True, eq=False)
class GroupedReduce(Paired):
    group_dim: str = ""
    new_dim: str = ""
    dims: Dims = Dims()

    def reduced(self, shape: Any) -> frozenset:
        return {self.group_dim} | self.dims.among(frozenset() if shape is None else shape.dims)

    def yields_to(self, index: frozenset, shape: Any) -> bool:
        return index.isdisjoint({self.new_dim} | self.reduced(shape))

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        return self.reduced(shape) <= _all(spans)


@dataclass(frozen=True, eq=False)
class WindowedReduce(Paired):
    window: Mapping[str, int] = field(default_factory=dict)

    def yields_to(self, index: frozenset, shape: Any) -> bool:
        return index.isdisjoint(self.window)

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        return _all(spans).issuperset(self.window)


@dataclass(frozen=True, eq=False)
class WeightedReduce(Paired):
    weight_dims: frozenset = frozenset()
    dims: Dims = EVERY

    def takes(self, spans: list[frozenset], shape: Any) -> bool:
        """Only if each variable has all dimensions: the weights would otherwise give it what it lacks by another variable's leave."""
        if self.dims.every and shape is None:
            return False
        own = self.weight_dims | (shape.dims if self.dims.every else self.dims.names)
        return all(own <= span for span in spans)


REDUCTIONS = ("count", "all", "any", "max", "min", "mean", "prod", "sum", "std", "var", "median")
SCANS = ("cumsum", "cumprod", "diff")
ELEMENTWISE = ("fillna", "astype", "round", "clip", "isnull", "notnull")
OPENERS = ("groupby", "groupby_bins", "resample", "rolling", "coarsen", "weighted", "rolling_exp", "cumulative")
SELECT_OPTIONS = ("drop", "missing_dims", "method", "tolerance")
CHUNK_OPTIONS = ("name_prefix", "token", "lock", "inline_array", "chunked_array_type", "from_array_kwargs")
WINDOW_OPTIONS = ("center", "min_periods", "boundary", "side", "coord_func", "keep_attrs")


def dims_of(value: Any) -> Dims:
    if value is None or value is Ellipsis:
        return EVERY
    if isinstance(value, str) or not hasattr(value, "__iter__"):
        return Dims(frozenset([value]))
    return Dims(frozenset(value))


def _plain(value: Any) -> bool:
    return value is None or isinstance(value, (bool, int, float, str, type)) or type(value).__name__ in ("dtype", "float64", "int64", "float32")


def step_of(name: str, args: tuple, kwargs: Mapping[str, Any], array: bool = False) -> Step:
    """The step that a call is; what isn't known here is Opaque."""
    said = {"name": name, "args": tuple(args), "kwargs": dict(kwargs)}
    if name in REDUCTIONS:
        return Reduce(**said, dims=dims_of(args[0] if args else kwargs.get("dim")), keepdims=bool(kwargs.get("keepdims", False)))
    if name == "reduce":
        return Reduce(**said, dims=dims_of(args[1] if len(args) > 1 else kwargs.get("dim")), keepdims=bool(kwargs.get("keepdims", False)))
    if name in ("isel", "sel"):
        from .specs import Pointwise, classify_index, raw_index

        own = dict(kwargs)
        options = {k: own.pop(k) for k in SELECT_OPTIONS if k in own}
        given = args[0] if args else own.pop("indexers", None)
        for k, v in zip(("drop", "missing_dims") if name == "isel" else ("method", "tolerance", "drop"), args[1:]):
            options[k] = v
        index = {**dict(given or {}), **own}
        index = {d: classify_index(d, v, name == "sel") for d, v in index.items()}
        if any(isinstance(v, Pointwise) for v in index.values()):
            return Opaque(**said)
        return Select(name, (), {**{d: raw_index(v) for d, v in index.items()}, **options}, index=index, options=options)
    if name in SCANS:
        return Scan(**said, dims=dims_of(args[0] if args else kwargs.get("dim")))
    if name in ELEMENTWISE and all(map(_plain, (*args, *kwargs.values()))):
        return Elementwise(**said)
    if name == "chunk":
        own = dict(kwargs)
        options = {k: own.pop(k) for k in CHUNK_OPTIONS if k in own}
        given = args[0] if args else own.pop("chunks", None)
        if given is not None and not isinstance(given, Mapping):
            return Rechunk(**said, uniform=given, options=options)
        return Rechunk(**said, chunks={**dict(given or {}), **own}, options=options)
    if name == "__getitem__" and not array:
        key = args[0]
        if isinstance(key, list):
            return Project(name, (key,), key=list(key))
        if isinstance(key, (str, tuple, int)) and not isinstance(key, bool):
            return Project(name, (key,), key=key)
        return Opaque(**said)
    if name == "drop_vars":
        given = args[0] if args else kwargs.get("names", ())
        return Drop(**said, names=(given,) if isinstance(given, str) or not hasattr(given, "__iter__") else tuple(given))
    if name == "rename":
        own = dict(kwargs)
        given = args[0] if args else own.pop("name_dict", own.pop("new_name_or_name_dict", None))
        if given is not None and not isinstance(given, Mapping):
            return Opaque(**said)
        return Rename(**said, mapping={**dict(given or {}), **own})
    return (Opener if name in OPENERS else Opaque)(**said)
