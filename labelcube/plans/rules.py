"""Where selections and projections of a plan go: as far to the front as every value stays the same.

A plan is laid step by step, like cards into a hand: a selection or a projection slides forward past each step that lets it, and is joined
with its like where they meet. Each step says itself what may pass it (steps.py). Catalyst reorders filters and columns by itself; what
this adds is what it can't see: which chains are impossible, how positions of positions compose, and a plan that shows what will run.
"""

from __future__ import annotations

from ..errors import InvalidExpressionError
from .shape import Shape, fold
from .specs import classify_chunk, compose, drops, raw_index
from .steps import Project, Rechunk, Select, Step


def joined_selects(first: Select, then: Select) -> Select | None:
    """One selection for two; None where options, kinds or positions keep them apart."""
    if first.name != then.name or first.options or then.options:
        return None
    index = dict(first.index)
    for dim, spec in then.index.items():
        if dim in index:
            spec = compose(index[dim], spec) if first.name == "isel" else None
            if spec is None:
                return None
        index[dim] = spec
    return Select(first.name, (), {d: raw_index(s) for d, s in index.items()}, index=index)


def joined_projects(first: Project, then: Project, shape: Shape | None) -> Project | None:
    """The second alone, if the first leaves all that it names, or a coordinate of what it leaves."""
    if first.single:
        return None
    if set(then.names) <= set(first.names):
        return then
    if not then.single or shape is None or then.key not in shape.coords:
        return None
    spanned = {d for n in first.names for d in shape.variables.get(n, ())}
    return then if spanned.issuperset(shape.variables[then.key]) else None


def joined_rechunks(first: Rechunk, then: Rechunk) -> Rechunk | None:
    """Chunks of both, the second's where both name a dimension, if these are plain sizes."""
    for one in (first, then):
        if one.options or one.uniform is not None or not one.chunks or any(classify_chunk(v).kind not in ("size", "whole", "same") for v in one.chunks.values()):
            return None
    chunks = {**first.chunks, **{d: v for d, v in then.chunks.items() if v is not None or d not in first.chunks}}
    return Rechunk("chunk", (chunks,), {}, chunks=chunks)


def after_selection(step: Rechunk, selection: Select) -> list[Step] | None:
    """What is left of a rechunk behind a selection that has passed it; None if it can't pass."""
    sizes = [step.uniform] if step.uniform is not None else list(step.chunks.values())
    if step.options or not sizes or not all(classify_chunk(v).crossable for v in sizes):
        return None
    if step.uniform is not None:
        return [step]
    gone = {d for d, s in selection.index.items() if drops(s)}
    chunks = {d: v for d, v in step.chunks.items() if d not in gone}
    return [Rechunk("chunk", (chunks,), {}, chunks=chunks)] if chunks else []


def _place_select(laid: list[Step], selection: Select, shape: Shape | None) -> list[Step]:
    behind: list[Step] = []
    while laid:
        step, before = laid[-1], fold(shape, laid[:-1])[-1]
        if isinstance(step, Select):
            one = joined_selects(step, selection)
            if one is None:
                break
            return _place_select(laid[:-1], one, shape) + behind
        if isinstance(step, Rechunk):
            rest = after_selection(step, selection)
            if rest is None:
                break
        elif step.yields_to(frozenset(selection.index), before):
            rest = [step]
        else:
            lost = step.ended(before) & set(selection.index)
            if lost and selection.options.get("missing_dims", "raise") == "raise":
                raise InvalidExpressionError(f"{selection.name}() indexes {sorted(map(str, lost))}, which {step.name}() has already reduced away")
            break
        laid, behind = laid[:-1], rest + behind
    return [*laid, selection, *behind]


def _place_project(laid: list[Step], projection: Project, shape: Shape | None) -> list[Step]:
    behind: list[Step] = []
    while laid:
        step, before = laid[-1], fold(shape, laid[:-1])[-1]
        if isinstance(step, Project):
            one = joined_projects(step, projection, before)
            if one is None:
                break
            laid, projection = laid[:-1], one
            continue
        if before is None or before.array or any(n not in before.variables or n in before.coords for n in projection.names):
            break
        if not step.takes([frozenset(before.variables[n]) for n in projection.names], before):
            break
        laid, behind = laid[:-1], [step, *behind]
    return [*laid, projection, *behind]


def _lay(laid: list[Step], step: Step, shape: Shape | None) -> list[Step]:
    if isinstance(step, Select):
        return _place_select(laid, step, shape)
    if isinstance(step, Project):
        return _place_project(laid, step, shape)
    if isinstance(step, Rechunk) and laid and isinstance(laid[-1], Rechunk):
        one = joined_rechunks(laid[-1], step)
        if one is not None:
            return [*laid[:-1], one]
    return [*laid, step]


def rewrite(steps: list[Step], shape: Shape | None) -> list[Step]:
    """The plan, laid anew until it stays as it is; no step is added, and none but selections and projections moves, forward only."""
    while True:
        laid: list[Step] = []
        for step in steps:
            laid = _lay(laid, step, shape)
        if len(laid) == len(steps) and all(a is b for a, b in zip(laid, steps)):
            return laid
        steps = laid
