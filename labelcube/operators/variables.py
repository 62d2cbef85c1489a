"""Which variables there are, what they are called and how their cells are dealt out."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F

from ..model import Axis, Cube, Group, key
from ..plans.steps import Drop, Project, Rechunk, Rename


def project(cube: Cube, step: Project) -> Cube:
    shape = cube.shape
    for n in step.names:
        if n not in shape.variables:
            raise KeyError(f"no variable is called {n!r}; there are {list(shape.variables)}")
    names = set(step.names)
    spanned = {d for n in names for d in shape.variables[n]}
    groups = []
    for g in cube.groups:
        own = tuple(v for v in g.vars if v in names or (v in cube.coords and set(g.dims) <= spanned))
        if own:
            groups.append(replace(g, df=g.df.select(*(f"`{k}`" for k in g.keys()), *(f"`{v}`" for v in own)), vars=own))
    axes = {d: a for d, a in cube.axes.items() if d in spanned}
    if step.single and (axis := cube.axis_of(step.key)) is not None:  # a coordinate as the variable itself
        table = axis.frame().select(f"`{key(axis.dim)}`", f"`{step.key}`")
        if step.key != axis.dim:
            groups.append(Group(table, (axis.dim,), (step.key,), True))
            axes[axis.dim] = replace(axis, coords=tuple(c for c in axis.coords if c != step.key))
    coords = cube.coords - ({step.key} if step.single else set())
    return replace(cube, axes=axes, groups=tuple(groups), coords=coords, array=step.single)


def drop(cube: Cube, step: Drop) -> Cube:
    known = set(cube.shape.variables)
    if (missing := [n for n in step.names if n not in known]) and step.kwargs.get("errors", "raise") == "raise":
        raise ValueError(f"no variables are called {missing}")
    gone = set(step.names)
    groups = []
    for g in cube.groups:
        own = tuple(v for v in g.vars if v not in gone)
        if own:
            groups.append(replace(g, df=g.df.select(*(f"`{k}`" for k in g.keys()), *(f"`{v}`" for v in own)), vars=own))
    axes = {d: replace(a, coords=tuple(c for c in a.coords if c not in gone)) for d, a in cube.axes.items()}
    spanned = {d for g in groups for d in g.dims}
    axes = {d: a for d, a in axes.items() if d in spanned or a.coords}
    return replace(cube, axes=axes, groups=tuple(groups), coords=cube.coords - gone, scalars={c: s for c, s in cube.scalars.items() if c not in gone})


def rename(cube: Cube, step: Rename) -> Cube:
    """All names change at once, so two may be exchanged."""
    new = lambda x: step.mapping.get(x, x)
    known = {*cube.shape.variables, *cube.dims}
    if missing := [n for n in step.mapping if n not in known]:
        raise ValueError(f"nothing is called {missing}")
    groups = tuple(
        Group(g.df.select(*(F.col(f"`{key(d)}`").alias(key(new(d))) for d in g.dims), *(F.col(f"`{v}`").alias(new(v)) for v in g.vars)), tuple(map(new, g.dims)), tuple(map(new, g.vars)), g.dense)
        for g in cube.groups
    )
    axes = {}
    for d, a in cube.axes.items():
        table = a.table if a.table is None else a.table.select(F.col(f"`{key(d)}`").alias(key(new(d))), *(F.col(f"`{c}`").alias(new(c)) for c in a.coords))
        axes[new(d)] = Axis(new(d), table, tuple(map(new, a.coords)), a.size, a.at)
    scalars = {new(c): s.select(F.col(f"`{c}`").alias(new(c))) for c, s in cube.scalars.items()}
    return replace(cube, axes=axes, groups=groups, coords=frozenset(map(new, cube.coords)), scalars=scalars, chunks={new(d): c for d, c in cube.chunks.items()})


def rechunk(cube: Cube, step: Rechunk) -> Cube:
    """Noted, not done: a shuffle in the middle of a plan is pure cost. partitioned() applies it to a result."""
    from ..plans.specs import classify_chunk

    own: dict[str, Any] = dict.fromkeys(cube.dims, step.uniform) if step.uniform is not None else dict(step.chunks)
    for d, v in own.items():
        if d not in cube.dims:
            raise ValueError(f"no dimension is called {d!r}")
        if classify_chunk(v).kind == "odd":
            raise ValueError(f"{v!r} is no chunk size")
    return replace(cube, chunks={**cube.chunks, **{d: v for d, v in own.items() if v is not None}})


def partitioned(cube: Cube) -> Cube:
    """Each group's rows dealt out by range of blocks along the chunked dimensions."""
    from ..plans.specs import classify_chunk

    groups = []
    for g in cube.groups:
        by = [F.floor(F.col(f"`{key(d)}`") / cube.chunks[d]) for d in g.dims if d in cube.chunks and classify_chunk(cube.chunks[d]).kind == "size"]
        groups.append(replace(g, df=g.df.repartitionByRange(*by)) if by else g)
    return replace(cube, groups=tuple(groups))
