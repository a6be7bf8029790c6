"""Names, paths and constants of a document's clauses, against a release."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from typing import Any

from quorumlake.functions.units import factor
from quorumlake.model import ORDERED, ColumnDef, Refusal, Release
from quorumlake.plans.clauses import All, Any_, Clause, Covered, Exists, Ids, Known, Not, Unknown, Value, asks, prefixed, simplified
from quorumlake.plans.graph import Step, path_to

#: Comparison operators with a value, as sugar for values and bounds.
OPERATORS = {"=": ("values", False), "!=": ("values", True), ">": ("gt", False), ">=": ("gte", False), "<": ("lt", False), "<=": ("lte", False)}
BOUNDS = ("gt", "gte", "lt", "lte")


class Resolver:
    """Clauses of one document. ``packs`` maps the name of a leaf kind to a function from its members to clauses."""

    def __init__(self, release: Release, unit: str, cohorts: Mapping[str, Any] | None = None, packs: Mapping[str, Callable[[Mapping], Any]] | None = None):
        self.release, self.unit, self.cohorts, self.packs = release, unit, cohorts or {}, packs or {}
        if not release.table(unit).key or release.table(unit).role == "coverage":
            raise Refusal("UNIT_WITHOUT_KEY", unit)

    def cohort(self, name: str, open_: tuple[str, ...] = ()) -> Clause:
        if name in open_:
            raise Refusal("COHORT_CYCLE", " -> ".join((*open_, name)))
        if name not in self.cohorts:
            raise Refusal("UNKNOWN_COHORT", name)
        return simplified(self.clause(self.cohorts[name], self.unit, (*open_, name)))

    def clause(self, written: Mapping[str, Any], table: str, open_: tuple[str, ...] = ()) -> Clause:
        for name, made in (("all", All), ("any", Any_)):
            if name in written:
                return made(tuple(self.clause(c, table, open_) for c in written[name]))
        for name, made in (("not", Not), ("known", Known), ("unknown", Unknown)):
            if name in written:
                return made(self.clause(written[name], table, open_))
        kind = written["kind"]
        if kind == "value":
            return self._value(written, table)
        if kind == "exists":
            return self._exists(written, table, open_)
        if kind == "covered":
            return self._covered(written, table)
        if kind == "ids":
            return self._ids(written, table)
        if kind == "cohort":
            if table != self.unit:
                raise Refusal("COHORT_NOT_ALLOWED", "a cohort is of units")
            return self.cohort(written["cohort"], open_)
        if kind in self.packs:
            return self.clause(self.packs[kind](written), table, open_)
        raise Refusal("UNKNOWN_KIND", kind)

    # Leaves

    def _value(self, written: Mapping[str, Any], table: str) -> Clause:
        if ":" in written["column"]:
            raise Refusal("NOT_SUPPORTED", "concept references")
        target, column = self.release.column(written["column"])
        path = () if target.name == table and not written.get("via") else path_to(self.release, table, target.name, written.get("via"))
        leaf = self._predicate(written, target.name, column)
        return self._chain(path, self._quantifiers(written, path), (leaf,), written.get("lift", "strict"), False)

    def _predicate(self, written: Mapping[str, Any], table: str, column: ColumnDef) -> Value:
        if column.datatype is None:
            raise Refusal("UNDECLARED_DATATYPE", column.name)
        given = [k for k in ("values", "range", "op") if k in written]
        if len(given) != 1:
            raise Refusal("INVALID_PREDICATE", "one of values, range and op is expected")
        negate, values, bounds = bool(written.get("negate", False)), written.get("values"), dict(written.get("range", {}))
        if "op" in written:
            name, turned = OPERATORS[written["op"]]
            negate ^= turned
            values, bounds = ([written["value"]], {}) if name == "values" else (None, {name: written["value"]})
        scale = factor(written["units"], column.units) if "units" in written and column.units else 1.0
        if "units" in written and not column.units:
            raise Refusal("UNITS_INCOMPATIBLE", column.name)
        if values is None:
            if not bounds or set(bounds) - set(BOUNDS):
                raise Refusal("INVALID_RANGE", ", ".join(bounds))
            if column.datatype not in ORDERED and not column.ordered:
                raise Refusal("NOT_ORDERED", column.name)
        elif not values:
            raise Refusal("INVALID_PREDICATE", "values are empty")
        made = None if values is None else tuple(dict.fromkeys(typed(v, column, scale) for v in values))
        limits = tuple((k, typed(bounds[k], column, scale)) for k in BOUNDS if k in bounds)
        return Value(table, column, (), made, limits, negate, written.get("match", "any"))

    def _quantifiers(self, written: Mapping[str, Any], path: tuple[Step, ...]) -> list[int | None]:
        """k of ``some`` or None for ``every``, for each down step."""
        n, given = sum(s.down for s in path), written.get("quantifier", "some")
        if isinstance(given, list) and len(given) != n:
            raise Refusal("QUANTIFIER_MISMATCH", f"{n} down steps, {len(given)} quantifiers")
        found = [_least(q) for q in given] if isinstance(given, list) else [_least(given)] * n
        if "min_count" in written and found:
            if found[-1] is None:
                raise Refusal("INVALID_QUANTIFIER", "min_count goes with some")
            found[-1] = int(written["min_count"])
        return found

    def _exists(self, written: Mapping[str, Any], table: str, open_: tuple[str, ...]) -> Clause:
        target = self.release.table(written["table"]).name
        path = path_to(self.release, table, target, written.get("via"))
        if not any(s.down for s in path):
            raise Refusal("INVALID_PATH", "an existence question goes down at least once")
        if not path[-1].down and not written.get("where"):
            raise Refusal("INVALID_PATH", "a path that ends with a lookup needs a where")
        where = tuple(self.clause(c, target) for c in written.get("where", ()))
        if any(isinstance(c, Ids) for c in where):
            raise Refusal("IDS_NOT_ALLOWED", "ids are of units")
        return self._chain(path, self._quantifiers(written, path), where, written.get("lift", "strict"), bool(written.get("exclude_self")))

    def _chain(self, path: tuple[Step, ...], quantifiers: list[int | None], where: tuple[Clause, ...], lift: str, exclude_self: bool) -> Clause:
        segments, ups = [], ()
        for step in path:
            if step.down:
                segments.append((ups, step))
                ups = ()
            else:
                ups = (*ups, step)
        inner = tuple(prefixed(c, ups) for c in where)
        if not segments:
            return inner[0]
        flat = simplified(All(inner)) if inner else None
        clauses = flat.members if isinstance(flat, All) else (flat,) if flat is not None else ()
        for i in range(len(segments) - 1, -1, -1):
            before, down = segments[i]
            node = Exists(before, down, quantifiers[i], clauses, lift if any(map(asks, clauses)) else None, exclude_self and i == 0)
            clauses = (node,)
        return clauses[0]

    def _covered(self, written: Mapping[str, Any], table: str) -> Clause:
        path = path_to(self.release, table, self.release.table(written["table"]).name, written.get("via"))
        if not path or not path[-1].down:
            raise Refusal("INVALID_PATH", "covered ends with a down step")
        scope = written.get("scope") or {}
        columns = self.release.tables[path[-1].end].columns
        return Covered(path, tuple(sorted((c, tuple(typed(v, columns[c]) for v in vs)) for c, vs in scope.items())), written.get("lift", "strict"))

    def _ids(self, written: Mapping[str, Any], table: str) -> Clause:
        if table != self.unit:
            raise Refusal("IDS_NOT_ALLOWED", "ids are of units")
        unit = self.release.table(self.unit)
        keys = [k if isinstance(k, list | tuple) else [k] for k in written["ids"]]
        return Ids(self.unit, tuple(dict.fromkeys(tuple(typed(v, unit.columns[c]) for v, c in zip(k, unit.key, strict=True)) for k in keys)))


def _least(quantifier: Any) -> int | None:
    if quantifier == "some":
        return 1
    if quantifier == "every":
        return None
    if isinstance(quantifier, Mapping) and set(quantifier) == {"some"} and int(quantifier["some"]) >= 1:
        return int(quantifier["some"])
    raise Refusal("INVALID_QUANTIFIER", repr(quantifier))


def typed(value: Any, column: ColumnDef, scale: float = 1.0) -> Any:
    """A constant as its column's datatype; refused where it isn't one."""
    kind = column.datatype
    wrong = Refusal("WRONG_TYPE", f"{value!r} for {column.name} ({kind})")
    if kind in ("number", "time_offset", "integer"):
        if isinstance(value, bool) or not isinstance(value, int | float | str):
            raise wrong
        if isinstance(value, str):  # integers beyond 2**53 are written as text
            if kind != "integer" or not value.lstrip("-").isdigit():
                raise wrong
            return int(value)
        return value if scale == 1.0 and kind == "integer" else float(value) * scale
    if kind == "boolean":
        if not isinstance(value, bool):
            raise wrong
        return value
    if not isinstance(value, str):
        raise wrong
    if kind == "date":
        return dt.date.fromisoformat(value)
    if kind == "datetime":
        when = dt.datetime.fromisoformat(value)
        return when.astimezone(dt.UTC).replace(tzinfo=None) if when.tzinfo else when
    if column.permissible and value not in column.permissible:
        raise Refusal("NOT_PERMISSIBLE", f"{value!r} for {column.name}")
    return value
