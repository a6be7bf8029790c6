"""What a server of releases tells about them: search, descriptions, analyses, checks of documents."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from quorumlake.engine import Engine
from quorumlake.model import ColumnDef, Refusal, Release
from quorumlake.operators import infer
from quorumlake.plans.document import KINDS, parse

#: What an analysis takes, for a client that builds views.
ANALYSES = {
    "compare.existence": {"cohorts": (2, 6), "params": ("predicates", "level"), "reference": True},
    "summary.distribution": {"cohorts": (1, 6), "params": ("variables", "edges"), "reference": False},
    "compare.columns": {"cohorts": (2, 6), "params": ("variables", "level"), "reference": False},
    "summary.members": {"cohorts": (1, 1), "params": ("offset", "limit"), "reference": False},
    "survival.km": {"cohorts": (1, 6), "params": ("endpoint", "landmarks", "level"), "reference": False},
    "survival.cox": {"cohorts": (1, 1), "params": ("endpoint", "variables", "level"), "reference": False},
}


@dataclass
class Entry:
    release: Release
    title: str = ""
    tags: tuple[str, ...] = ()
    facets: Mapping[str, str] = field(default_factory=dict)
    rows: Mapping[str, int] = field(default_factory=dict)


class Catalog:
    def __init__(self, entries: Iterable[Entry]):
        self.entries = {e.release.name: e for e in entries}

    def entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise Refusal("UNKNOWN_DATASET", name)
        return self.entries[name]

    def search(self, text: str = "", tags: Iterable[str] = (), facets: Mapping[str, str] | None = None, min_rows: int = 0, role: str | None = None, offset: int = 0, limit: int = 20) -> list[str]:
        """Names of datasets that match all that is given, in order."""
        found = []
        for name in sorted(self.entries):
            e = self.entries[name]
            said = " ".join([name, e.title, *e.release.tables, *(c for t in e.release.tables.values() for c in t.columns)]).lower()
            fits = all(w in said for w in text.lower().split()) and set(tags) <= set(e.tags) and all(e.facets.get(k) == v for k, v in (facets or {}).items())
            if fits and (not min_rows or max(e.rows.values(), default=0) >= min_rows) and (role is None or any(t.role == role for t in e.release.tables.values())):
                found.append(name)
        return found[offset : offset + limit]

    def describe_dataset(self, name: str) -> dict[str, Any]:
        r = self.entry(name).release
        return {
            "tables": {t.name: {"key": list(t.key), "role": t.role, "columns": list(t.columns)} for t in r.tables.values()},
            "relationships": {x.id: {"child": x.child, "parent": x.parent, "one_to_one": x.one_to_one, "coverage": r.covered_by(x).parents} for x in r.relationships},
            "endpoints": sorted(r.endpoints),
        }

    def describe_column(self, name: str, column: str) -> dict[str, Any]:
        """A column's declarations and its statistics: one aggregation over its table."""
        table, made = self.entry(name).release.column(column)
        row = infer.column_statistics(table.frame, [made.name]).first().asDict()
        return {"datatype": made.datatype, "units": made.units, "permissible": list(made.permissible), "ordered": made.ordered, "missing": dict(made.missing), "statistics": row}

    def curation_queue(self, name: str) -> list[str]:
        """Columns that nobody has confirmed or typed."""
        r = self.entry(name).release
        return sorted(f"{t.name}.{c.name}" for t in r.tables.values() for c in t.columns.values() if c.proposed or c.datatype is None)

    def propose(self, name: str, column: str) -> ColumnDef:
        """A column with the datatype that its values suggest, marked as proposed."""
        table, made = self.entry(name).release.column(column)
        kind = infer.datatypes(table.frame.select(made.name)).first()["datatype"]
        return ColumnDef(made.name, kind, made.units, made.permissible, made.ordered, made.missing, True)

    def validate(self, name: str, document: str | Mapping) -> str | None:
        """The code of the first refusal of a document, or none."""
        try:
            doc = parse(document)
            made = Engine(self.entry(name).release)
            _, _, clauses = made.cohorts(doc)
            for view in doc.views:
                self._check_view(made, view, len(clauses))
        except Refusal as refused:
            return refused.code
        return None

    def _check_view(self, made: Engine, view: Mapping[str, Any], cohorts: int) -> None:
        if view.get("analysis") not in made.analyses:
            raise Refusal("UNKNOWN_ANALYSIS", str(view.get("analysis")))
        takes = ANALYSES.get(view["analysis"])
        n = len(view.get("cohorts", ())) or cohorts
        if takes and not takes["cohorts"][0] <= n <= takes["cohorts"][1]:
            raise Refusal("COHORT_ARITY", f"{view['analysis']} of {n}")
        if takes and set(view.get("params", {})) - set(takes["params"]):
            raise Refusal("UNKNOWN_PARAM", ", ".join(sorted(set(view["params"]) - set(takes["params"]))))

    @staticmethod
    def list_analyses() -> list[str]:
        return sorted(ANALYSES)

    @staticmethod
    def list_leaf_kinds(engine: Engine | None = None) -> list[str]:
        return [*KINDS, *sorted(engine.leaf_kinds if engine else ())]


def applicable(release: Release, unit: str) -> dict[str, bool]:
    """Which analyses a unit table has the columns for."""
    columns = release.table(unit).columns.values()
    outcome = any(e.time in release.tables[unit].columns for e in release.endpoints.values())
    described = any(c.datatype not in (None, "string") for c in columns)
    return {name: outcome if name.startswith("survival") else described or name in ("summary.members", "compare.existence") for name in ANALYSES}
