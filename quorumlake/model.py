"""Data model: tables with typed columns and cell states, relationships, coverage, releases.

A cell is a value and a state. The state column ``<name>__state`` exists only where a
column can be other than present; a null value without one reads as UNKNOWN.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logical datatypes and cell states.
DATATYPES = ("number", "integer", "string", "boolean", "category", "list<category>", "date", "datetime", "time_offset")
ORDERED = ("number", "integer", "date", "datetime", "time_offset")
PRESENT, NOT_APPLICABLE, NOT_ASSESSED, UNKNOWN = "PRESENT", "NOT_APPLICABLE", "NOT_ASSESSED", "UNKNOWN"


class Refusal(ValueError):
    """A query that the engine refuses, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class ColumnDef:
    name: str
    datatype: str | None
    units: str | None = None
    permissible: tuple[str, ...] = ()
    ordered: bool = False
    missing: tuple[tuple[str, str], ...] = ()  # (code, state)
    proposed: bool = False

    @property
    def state(self) -> str:
        return f"{self.name}__state"


@dataclass(frozen=True)
class Relationship:
    """A foreign key: child columns refer to the parent's key columns."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    role: str | None = None
    one_to_one: bool = False

    @property
    def id(self) -> str:
        return f"rel:{self.child}.{self.role or '+'.join(self.columns)}"


@dataclass(frozen=True)
class Coverage:
    """Which parents a relationship's children are known for.

    ``parents`` is ``undeclared``, ``all``, ``direct`` or ``grouped``. A direct listing is ``table`` with the
    parent's key in ``parent_columns`` and, for scoped coverage, ``scope``: pairs of (child column, its
    column in the listing). A grouped one has the assignment in ``table`` (parent and ``group``) and the
    listing in ``groups`` (``groups_key`` and the scope columns, or ``covers_all``).
    """

    parents: str = "undeclared"
    table: str | None = None
    parent_columns: tuple[str, ...] = ()
    scope: tuple[tuple[str, str], ...] = ()
    group: str | None = None
    groups: str | None = None
    groups_key: str | None = None
    covers_all: str | None = None
    record_filter: Any = None
    parent_scope: Any = None
    proposed: bool = False


@dataclass(frozen=True)
class Endpoint:
    """A time-to-event outcome of a unit table."""

    id: str
    time: str
    status: str
    events: tuple[Any, ...]
    censored: tuple[Any, ...]
    entry: str | None = None


@dataclass
class TableDef:
    name: str
    frame: DataFrame
    columns: dict[str, ColumnDef]
    key: tuple[str, ...] = ()
    role: str = "entity"


@dataclass
class Release:
    """An immutable set of tables and what is declared about them."""

    name: str
    tables: dict[str, TableDef]
    relationships: tuple[Relationship, ...] = ()
    coverage: dict[str, Coverage] = field(default_factory=dict)
    endpoints: dict[str, Endpoint] = field(default_factory=dict)

    def relationship(self, id_: str) -> Relationship:
        for r in self.relationships:
            if r.id == id_:
                return r
        raise Refusal("UNKNOWN_RELATIONSHIP", id_)

    def table(self, name: str) -> TableDef:
        if name not in self.tables:
            raise Refusal("UNKNOWN_TABLE", name)
        return self.tables[name]

    def column(self, qualified: str) -> tuple[TableDef, ColumnDef]:
        name, _, column = qualified.partition(".")
        table = self.table(name)
        if column not in table.columns:
            raise Refusal("UNKNOWN_COLUMN", qualified)
        return table, table.columns[column]

    def covered_by(self, rel: Relationship) -> Coverage:
        return self.coverage.get(rel.id, Coverage())

    def flag_bit(self, rel: Relationship, kind: int) -> int:
        """The bit of a relationship's flag: kind 0 is SCOPE_PARTIAL, 1 COVERAGE_PROPOSED."""
        return 2 * self.relationships.index(rel) + kind

    def declare(self, table: str, column: str, **changes: Any) -> Release:
        """The release with some of a column's declarations changed; states follow new missing codes."""
        old = self.tables[table]
        made = replace(old.columns[column], **changes)
        frame = with_states(old.frame, made) if made.missing else old.frame
        tables = self.tables | {table: TableDef(old.name, frame, old.columns | {column: made}, old.key, old.role)}
        return Release(self.name, tables, self.relationships, self.coverage, self.endpoints)

    def cover(self, rel: str, coverage: Coverage) -> Release:
        return Release(self.name, self.tables, self.relationships, self.coverage | {rel: coverage}, self.endpoints)


def with_states(frame: DataFrame, column: ColumnDef) -> DataFrame:
    """A state column from missing codes: tokens that match exactly lose their value and get the code's state."""
    token = F.col(column.name).cast("string")
    state = F.when(token.isNull(), UNKNOWN)
    for code, named in column.missing:
        state = state.when(token == code, named)
    frame = frame.withColumn(column.state, state.otherwise(PRESENT))
    return frame.withColumn(column.name, F.when(F.col(column.state) == PRESENT, F.col(column.name)))


def state_of(frame: DataFrame, column: ColumnDef, prefix: str = "") -> Column:
    """A column's state; a number that isn't finite is UNKNOWN."""
    value = F.col(prefix + column.name)
    bare = F.when(value.isNull(), UNKNOWN)
    if column.datatype in ("number", "time_offset"):
        bare = bare.when(F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf")), UNKNOWN)
    bare = bare.otherwise(PRESENT)
    if prefix + column.state in frame.columns:
        return F.when(F.col(prefix + column.state) != PRESENT, F.col(prefix + column.state)).otherwise(bare)
    return bare


def table_from(name: str, frame: DataFrame, key: tuple[str, ...] = (), columns: dict[str, dict] | None = None, role: str = "entity") -> TableDef:
    """A table whose columns' datatypes follow the frame's, with declarations by column name."""
    kinds = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "number", "float": "number", "boolean": "boolean", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "array<string>": "list<category>"}
    defs = {}
    for column, kind in frame.dtypes:
        if not column.endswith("__state"):
            defs[column] = ColumnDef(column, **({"datatype": kinds.get(kind, "category")} | (columns or {}).get(column, {})))
    for d in defs.values():
        if d.missing:
            frame = with_states(frame, d)
    return TableDef(name, frame, defs, key, role)
