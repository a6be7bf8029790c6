"""The resolved clause tree: nine kinds of nodes, hashable so that equal questions are asked once."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from quorumlake.model import ColumnDef
from quorumlake.plans.graph import Step

Ups = tuple[Step, ...]


@dataclass(frozen=True)
class Value:
    """A predicate on a column of the row, or of a row looked up from it."""

    table: str  # the column's
    column: ColumnDef
    ups: Ups = ()
    values: tuple[Any, ...] | None = None
    bounds: tuple[tuple[str, Any], ...] = ()
    negate: bool = False
    match: str = "any"


@dataclass(frozen=True)
class Exists:
    """One down step, after lookups. ``least`` is k of ``some``, or None for ``every``."""

    ups: Ups
    down: Step
    least: int | None
    where: tuple[Any, ...] = ()
    lift: str | None = None  # only where a clause asks a further question
    exclude_self: bool = False


@dataclass(frozen=True)
class Covered:
    path: tuple[Step, ...]
    scope: tuple[tuple[str, tuple[Any, ...]], ...] = ()
    lift: str = "strict"


@dataclass(frozen=True)
class Ids:
    table: str
    keys: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class All:
    members: tuple[Any, ...]


@dataclass(frozen=True)
class Any_:
    members: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    member: Any


@dataclass(frozen=True)
class Known:
    member: Any


@dataclass(frozen=True)
class Unknown:
    member: Any


Clause = Value | Exists | Covered | Ids | All | Any_ | Not | Known | Unknown


def asks(clause: Clause) -> bool:
    """Whether a clause holds an existence question."""
    if isinstance(clause, Exists | Covered):
        return True
    if isinstance(clause, All | Any_):
        return any(map(asks, clause.members))
    return isinstance(clause, Not | Known | Unknown) and asks(clause.member)


def prefixed(clause: Clause, ups: Ups) -> Clause:
    """The clause asked from a row ``ups`` lookups further down."""
    if not ups:
        return clause
    if isinstance(clause, Value):
        return Value(clause.table, clause.column, ups + clause.ups, clause.values, clause.bounds, clause.negate, clause.match)
    if isinstance(clause, Exists):
        return Exists(ups + clause.ups, clause.down, clause.least, clause.where, clause.lift, clause.exclude_self)
    if isinstance(clause, Covered):
        return Covered(ups + clause.path, clause.scope, clause.lift)
    if isinstance(clause, All | Any_):
        return type(clause)(tuple(prefixed(c, ups) for c in clause.members))
    if isinstance(clause, Not | Known | Unknown):
        return type(clause)(prefixed(clause.member, ups))
    raise TypeError(clause)


def flipped(clause: Clause) -> Clause:
    """The clause with every lift the other way: strict for assessed and back."""
    other = {"strict": "assessed", "assessed": "strict", None: None}
    if isinstance(clause, Exists):
        return Exists(clause.ups, clause.down, clause.least, tuple(map(flipped, clause.where)), other[clause.lift], clause.exclude_self)
    if isinstance(clause, Covered):
        return Covered(clause.path, clause.scope, other[clause.lift])
    if isinstance(clause, All | Any_):
        return type(clause)(tuple(map(flipped, clause.members)))
    if isinstance(clause, Not | Known | Unknown):
        return type(clause)(flipped(clause.member))
    return clause


def has_lift(clause: Clause) -> bool:
    return flipped(clause) != clause


def simplified(clause: Clause) -> Clause:
    """Nested combinators of one kind flattened, singletons unwrapped, repeated members and double negations gone."""
    if isinstance(clause, All | Any_):
        members: list[Clause] = []
        for c in map(simplified, clause.members):
            for m in c.members if isinstance(c, type(clause)) else (c,):
                if m not in members:
                    members.append(m)
        return members[0] if len(members) == 1 else type(clause)(tuple(members))
    if isinstance(clause, Not):
        inner = simplified(clause.member)
        return inner.member if isinstance(inner, Not) else Not(inner)
    if isinstance(clause, Known | Unknown):
        return type(clause)(simplified(clause.member))
    if isinstance(clause, Exists):
        where = simplified(All(clause.where)) if clause.where else None
        flat = where.members if isinstance(where, All) else (where,) if where is not None else ()
        return Exists(clause.ups, clause.down, clause.least, tuple(flat), clause.lift, clause.exclude_self)
    return clause
