"""Canonical text (RFC 8785 order and numbers) and the ids hashed from it."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.plans.clauses import All, Any_, Clause, Covered, Exists, Ids, Known, Not, Value


def canonical_number(x: float) -> str:
    """As ECMAScript writes it."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("numbers are finite")
    if x == 0:
        return "0"
    sign, text = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) if whole != "0" else int(exponent or 0) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0") or "0"
    if 0 < point <= 21:
        body = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + body


def canonical(value: Any) -> str:
    """JSON with members in the order of their names' UTF-16 units."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        return canonical_number(value)
    if isinstance(value, Mapping):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in items) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    return canonical(str(value))


def hashed(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def clause_form(clause: Clause) -> Any:
    """A clause with everything whose order means nothing sorted."""
    if isinstance(clause, All | Any_):
        return {"all" if isinstance(clause, All) else "any": sorted({canonical(clause_form(c)): clause_form(c) for c in clause.members}.items())}
    if isinstance(clause, Not):
        return {"not": clause_form(clause.member)}
    if isinstance(clause, Exists):
        return {"exists": [s.rel.id for s in (*clause.ups, clause.down)], "least": clause.least, "lift": clause.lift, "exclude_self": clause.exclude_self, "where": sorted(canonical(clause_form(c)) for c in clause.where)}
    if isinstance(clause, Covered):
        return {"covered": [s.rel.id for s in clause.path], "scope": {c: sorted(map(str, v)) for c, v in clause.scope}, "lift": clause.lift}
    if isinstance(clause, Ids):
        return {"ids": sorted(canonical(list(map(_plain, k))) for k in clause.keys), "table": clause.table}
    if isinstance(clause, Value):
        values = None if clause.values is None else sorted(canonical(_plain(v)) for v in clause.values)
        return {"value": f"{clause.table}.{clause.column.name}", "via": [s.rel.id for s in clause.ups], "values": values, "range": {k: _plain(v) for k, v in clause.bounds}, "negate": clause.negate, "match": clause.match}
    name = "known" if isinstance(clause, Known) else "unknown"
    return {name: clause_form(clause.member)}


def _plain(v: Any) -> Any:
    return v if isinstance(v, bool | int | float | str) else asdict(v) if is_dataclass(v) else v.isoformat()


def cohort_id(dataset: str, unit: str, clause: Clause) -> str:
    return "drv:" + hashed({"dataset": dataset, "unit": unit, "cohort": clause_form(clause)})


def leaf_id(clause: Clause) -> str:
    return "leaf:" + hashed(clause_form(clause))


def utf16_order(c: Column) -> Column:
    """A sort key by UTF-16 units; Spark itself sorts by UTF-8 bytes."""
    return F.encode(c.cast("string"), "UTF-16BE")


def readback(clause: Clause) -> str:
    """A clause in English."""
    if isinstance(clause, All | Any_):
        word = " and " if isinstance(clause, All) else " or "
        return "(" + word.join(map(readback, clause.members)) + ")" if clause.members else "anything" if isinstance(clause, All) else "nothing"
    if isinstance(clause, Not):
        return f"not {readback(clause.member)}"
    if isinstance(clause, Value):
        what = "one of " + ", ".join(map(str, clause.values)) if clause.values is not None else " and ".join(f"{ {'gt': 'over', 'gte': 'at least', 'lt': 'under', 'lte': 'at most'}[k]} {v}" for k, v in clause.bounds)
        return f"{clause.table}.{clause.column.name} is {'not ' if clause.negate else ''}{what}"
    if isinstance(clause, Exists):
        many = "every" if clause.least is None else f"at least {clause.least}"
        where = f" where {' and '.join(map(readback, clause.where))}" if clause.where else ""
        return f"{many} {'other ' if clause.exclude_self else ''}{clause.down.end} row{where}"
    if isinstance(clause, Covered):
        return f"{clause.path[-1].end} rows are recorded"
    if isinstance(clause, Ids):
        return f"one of {len(clause.keys)} named {clause.table} rows"
    return f"whether {readback(clause.member)} is {'known' if isinstance(clause, Known) else 'unknown'}"
