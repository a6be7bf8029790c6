"""Curation over re-imports: what people declared is carried to a new import's proposals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import fields, replace

from quorumlake.model import ColumnDef, Endpoint, Release

#: Outcomes that clinical tables name, by the prefix of their columns, and how a status is written.
OUTCOMES = ("OS", "DFS", "PFS", "DSS")
EVENT_WORDS, CENSORED_WORDS = ("1:DECEASED", "1:Recurred/Progressed", "1:PROGRESSION", "1:DEAD WITH TUMOR"), ("0:LIVING", "0:DiseaseFree", "0:CENSORED", "0:ALIVE OR DEAD TUMOR FREE")


def carried(base: ColumnDef, curated: ColumnDef, fresh: ColumnDef) -> tuple[ColumnDef, list[str]]:
    """The new import's column with each field that was curated since the last import, and the fields both changed."""
    changes, conflicts = {}, []
    for f in fields(ColumnDef):
        if f.name == "name":
            continue
        was, own, new = getattr(base, f.name), getattr(curated, f.name), getattr(fresh, f.name)
        if own != was:
            changes[f.name] = own
            if new not in (was, own):
                conflicts.append(f.name)
    return replace(fresh, **changes), conflicts


def carry_forward(base: Mapping[str, ColumnDef], curated: Mapping[str, ColumnDef], fresh: Mapping[str, ColumnDef]) -> tuple[dict[str, ColumnDef], list[str]]:
    """All columns of a new import; new ones are proposed, and conflicts are named ``column.field``."""
    out, conflicts = {}, []
    for name, column in fresh.items():
        if name in base and name in curated:
            out[name], some = carried(base[name], curated[name], column)
            conflicts += [f"{name}.{c}" for c in some]
        else:
            out[name] = replace(column, proposed=True)
    return out, conflicts


def proposed_endpoints(columns: Iterable[str]) -> list[Endpoint]:
    """Outcomes of which a table has both the months and the status."""
    have = set(columns)
    return [Endpoint(f"ep:{o.lower()}", f"{o}_MONTHS", f"{o}_STATUS", EVENT_WORDS, CENSORED_WORDS) for o in OUTCOMES if {f"{o}_MONTHS", f"{o}_STATUS"} <= have]


def unconfirmed(release: Release, columns: Iterable[str]) -> list[str]:
    """Columns that a query read and nobody has confirmed."""
    return sorted(c for c in columns if release.column(c)[1].proposed)
