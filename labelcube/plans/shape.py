"""What is known of a dataset without its data: variables, their dimensions, coordinates and sizes, folded through a plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from .specs import drops
from .steps import (
    Drop, Elementwise, GroupedReduce, Opaque, Project, Rechunk, Reduce, Rename, Scan, Select, Step, WeightedReduce, WindowedReduce,
)


@dataclass(frozen=True)
class Shape:
    """variables: name to dimensions, coordinates among them; sizes: a number, or None where it isn't known."""

    variables: Mapping[Any, tuple]
    coords: frozenset
    sizes: Mapping[Any, int | None]
    array: bool = False

    @property
    def dims(self) -> frozenset:
        return frozenset(d for own in self.variables.values() for d in own)

    @property
    def data(self) -> list:
        return [v for v in self.variables if v not in self.coords]

    def _of(self, variables: Mapping, coords: frozenset | None = None, **sizes: int | None) -> Shape:
        own = self.coords if coords is None else coords
        known = {**self.sizes, **sizes}
        left = {d for v in variables.values() for d in v}
        return replace(self, variables=dict(variables), coords=frozenset(c for c in own if c in variables), sizes={d: n for d, n in known.items() if d in left})


def after(shape: Shape, step: Step) -> Shape | None:
    """The shape after a step; None where nothing can be said any more."""
    variables = shape.variables
    match step:
        case Opaque():
            return None
        case Elementwise() | Rechunk():
            return shape
        case Reduce(dims=dims, keepdims=keep):
            gone = dims.among(shape.dims)
            if keep:
                kept = {v: d for v, d in variables.items() if v not in shape.coords or not gone & set(d)}
                return shape._of(kept, **{d: 1 for d in gone})
            return shape._of(_reduced(shape, gone))
        case Select(index=index, options=options):
            scalar = {d for d, s in index.items() if drops(s)}
            sizes = {d: s.size(shape.sizes.get(d)) for d, s in index.items() if d not in scalar}
            out = {}
            for v, d in variables.items():
                if options.get("drop") and v in shape.coords and scalar & set(d):
                    continue
                out[v] = tuple(x for x in d if x not in scalar)
            return shape._of(out, **sizes)
        case Project(names=names):
            own = {n: variables[n] for n in names if n in variables}
            spanned = {d for v in own.values() for d in v}
            kept = {v: d for v, d in variables.items() if v in own or (v in shape.coords and set(d) <= spanned)}
            return replace(shape._of(kept), array=step.single)
        case Drop(names=names):
            return shape._of({v: d for v, d in variables.items() if v not in names})
        case Rename(mapping=mapping):
            new = lambda x: mapping.get(x, x)
            return replace(shape, variables={new(v): tuple(map(new, d)) for v, d in variables.items()}, coords=frozenset(map(new, shape.coords)), sizes={new(d): n for d, n in shape.sizes.items()})
        case Scan(name="diff", dims=dims, args=args, kwargs=kwargs):
            n = args[1] if len(args) > 1 else kwargs.get("n", 1)
            return shape._of(variables, **{d: None if shape.sizes.get(d) is None else max(0, shape.sizes[d] - n) for d in dims.among(shape.dims)})
        case Scan():
            return shape
        case GroupedReduce(group_dim=old, new_dim=new, dims=dims):
            gone = dims.among(shape.dims) if not dims.every else frozenset([old])
            reduced = _reduced(shape, gone | {old})
            out = {v: d if v in shape.coords else (new, *d) for v, d in reduced.items()}
            if old != new or old in variables:
                out[new] = (new,)
            return shape._of(out, shape.coords | {new}, **{new: None})
        case WindowedReduce(name=name, window=window):
            if name == "rolling":
                return shape
            sizes = {d: None if (n := shape.sizes.get(d)) is None else -(-n // w) if step.kwargs.get("boundary") == "pad" else n // w for d, w in window.items()}
            return shape._of(variables, **sizes)
        case WeightedReduce(weight_dims=over, dims=dims):
            gone = dims.among(shape.dims | over)
            out = {v: d if v in shape.coords else (*d, *sorted(over - set(d), key=str)) for v, d in variables.items()}
            return replace(shape, variables=out)._of(_reduced(replace(shape, variables=out), gone), **{d: None for d in over})
    return None


def _reduced(shape: Shape, gone: frozenset) -> dict:
    return {v: tuple(x for x in d if x not in gone) for v, d in shape.variables.items() if v not in shape.coords or not gone & set(d)}


def fold(shape: Shape | None, steps: list[Step]) -> list[Shape | None]:
    """The shape before each step, and after the last."""
    out = [shape]
    for step in steps:
        shape = None if shape is None else after(shape, step)
        out.append(shape)
    return out
