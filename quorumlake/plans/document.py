"""JSON documents: parameters, checks that need no release, and the parts of a query."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from quorumlake.model import Refusal

#: Limits of a document.
MAX_COHORTS, MAX_VIEWS, MAX_PREDICATES, MAX_VARIABLES, MAX_LEAVES, MAX_DEPTH = 6, 8, 16, 8, 64, 8
MAX_NUMBER = 2**53 - 1
COMBINATORS = ("all", "any", "not", "known", "unknown")
KINDS = ("value", "exists", "covered", "ids", "cohort")


@dataclass(frozen=True)
class Document:
    dataset: str
    unit: str
    cohorts: Mapping[str, Any]
    views: tuple[Mapping[str, Any], ...]


def _pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
    if len({k for k, _ in items}) != len(items):
        raise Refusal("DUPLICATE_MEMBER", "an object names a member twice")
    return dict(items)


def parse(text: str | Mapping[str, Any]) -> Document:
    """A document from JSON text or an object, its parameters substituted and its form checked."""
    raw = json.loads(text, object_pairs_hook=_pairs) if isinstance(text, str) else dict(text)
    raw = substituted(raw, raw.pop("params", None) or {})
    _checked_values(raw)
    for name in ("dataset", "unit", "cohorts"):
        if name not in raw:
            raise Refusal("MISSING_MEMBER", name)
    if not 1 <= len(raw["cohorts"]) <= MAX_COHORTS:
        raise Refusal("TOO_MANY_COHORTS", str(len(raw["cohorts"])))
    views = tuple(raw.get("views", ()))
    if len(views) > MAX_VIEWS:
        raise Refusal("TOO_MANY_VIEWS", str(len(views)))
    for name, clause in raw["cohorts"].items():
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise Refusal("INVALID_NAME", name)
        check_clause(clause)
    return Document(raw["dataset"], raw["unit"], raw["cohorts"], views)


def substituted(value: Any, params: Mapping[str, Any]) -> Any:
    """``"$name"`` replaced by the parameter of that name; ``"$$"`` starts a plain text."""
    if isinstance(value, Mapping):
        return {k: substituted(v, params) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [substituted(v, params) for v in value]
    if isinstance(value, str) and value.startswith("$"):
        if value.startswith("$$"):
            return value[1:]
        if value[1:] not in params:
            raise Refusal("UNKNOWN_PARAM", value)
        return params[value[1:]]
    return value


def _checked_values(value: Any) -> None:
    if value is None:
        raise Refusal("NULL_VALUE", "null is never a value")
    if isinstance(value, bool):
        return
    if isinstance(value, int) and abs(value) > MAX_NUMBER:
        raise Refusal("NUMBER_TOO_LARGE", str(value))
    for inner in value.values() if isinstance(value, Mapping) else value if isinstance(value, list) else ():
        _checked_values(inner)


def check_clause(clause: Any, depth: int = 0) -> int:
    """The number of leaves of a clause whose form is right."""
    if depth > MAX_DEPTH:
        raise Refusal("TOO_DEEP", f"more than {MAX_DEPTH} levels")
    if not isinstance(clause, Mapping):
        raise Refusal("INVALID_CLAUSE", repr(clause))
    if "kind" in clause:
        if clause["kind"] not in KINDS and "." not in clause["kind"]:
            raise Refusal("UNKNOWN_KIND", clause["kind"])
        leaves = 1 + sum(check_clause(c, depth + 1) for c in clause.get("where", ()))
    else:
        named = [k for k in COMBINATORS if k in clause]
        if len(named) != 1 or len(clause) != 1:
            raise Refusal("INVALID_CLAUSE", f"one of {', '.join(COMBINATORS)} is expected")
        inner = clause[named[0]]
        leaves = sum(check_clause(c, depth + 1) for c in (inner if named[0] in ("all", "any") else [inner]))
    if leaves > MAX_LEAVES:
        raise Refusal("TOO_MANY_LEAVES", str(leaves))
    return leaves
