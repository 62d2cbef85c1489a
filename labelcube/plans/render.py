"""Plans as text."""

from __future__ import annotations

from typing import Any

from .steps import Dims, GroupedReduce, Opaque, Paired, Reduce, Step, WeightedReduce


class Explanation(str):
    """Text that shows as itself."""

    def __repr__(self) -> str:
        return str(self)


def _value(x: Any) -> str:
    text = repr(x)
    return f"<{type(x).__name__}>" if "\n" in text else text


def _call(name: str, args: tuple, kwargs: Any) -> str:
    if name == "__getitem__":
        return f"[{_value(args[0])}]"
    return f"{name}({', '.join([*map(_value, args), *(f'{k}={_value(v)}' for k, v in kwargs.items())])})"


def _names(dims: Any) -> str:
    return "{" + ", ".join(sorted(map(str, dims))) + "}"


def _consumed(dims: Dims) -> str:
    if dims.every:
        return "consumes=every dim"
    return f"consumes={_names(dims.names)}" if dims.names else ""


def note(step: Step) -> str:
    """What the calls leave unsaid."""
    match step:
        case Reduce(dims=dims, keepdims=True):
            return "keeps every dim at size 1" if dims.every else f"keeps {_names(dims.names)} at size 1" if dims.names else ""
        case Reduce(dims=dims):
            return _consumed(dims)
        case GroupedReduce(group_dim=old, new_dim=new):
            return f"{old} -> {new}"
        case WeightedReduce(weight_dims=over, dims=dims):
            return ", ".join(x for x in (f"weights over {_names(over)}" if over else "", _consumed(dims)) if x)
        case Opaque():
            return "not modelled -- nothing crosses it"
    return ""


def calls(step: Step) -> str:
    text = _call(step.name, step.args, step.kwargs)
    if isinstance(step, Paired):
        text += "." + _call(step.closer.name, step.closer.args, step.closer.kwargs)
    return text


def format_plan(steps: list[Step]) -> str:
    if not steps:
        return "plan (0 ops)"
    lines = [f"plan ({len(steps)} ops):"]
    for i, step in enumerate(steps, 1):
        said = note(step)
        lines.append(f"  {i}. {type(step).__name__}  {calls(step)}" + (f"  [{said}]" if said else ""))
    return "\n".join(lines)
