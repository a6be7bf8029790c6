"""Database snapshots: base tables with their declared keys."""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Snapshot:
    tables: dict[str, DataFrame]
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: list[tuple[str, tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=list)


def read_jdbc(spark: SparkSession, url: str, tables: list[str], properties: dict[str, str] | None = None, partitioned: dict[str, tuple[str, int, int, int]] | None = None) -> Snapshot:
    """Tables over JDBC, read at repeatable isolation; ``partitioned`` names (column, low, high, parts) of large ones."""
    out = {}
    for name in tables:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("isolationLevel", "REPEATABLE_READ").options(**(properties or {}))
        if name in (partitioned or {}):
            column, low, high, parts = partitioned[name]
            reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        out[name] = reader.load()
    return Snapshot(out)


def read_sqlite(spark: SparkSession, path: str) -> Snapshot:
    """A local SQLite file in one read transaction, handed over in blocks of rows."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        db.execute("BEGIN")
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        made = Snapshot({})
        for name in names:
            quoted = '"' + name.replace('"', '""') + '"'
            info = db.execute(f"PRAGMA table_info({quoted})").fetchall()
            kinds = {"INTEGER": "bigint", "REAL": "double"}
            schema = ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in info)
            casts = [{"bigint": int, "double": float}.get(kinds.get(c[2].upper()), str) for c in info]
            cursor = db.execute(f"SELECT * FROM {quoted}")
            frame = None
            while rows := cursor.fetchmany(50_000):
                block = spark.createDataFrame([tuple(None if v is None else f(v) for v, f in zip(r, casts, strict=True)) for r in rows], schema)
                frame = block if frame is None else frame.unionByName(block)
            made.tables[name] = frame if frame is not None else spark.createDataFrame([], schema)
            if key := tuple(c[1] for c in sorted(info, key=lambda c: c[5]) if c[5]):
                made.keys[name] = key
            by_id: dict[int, list] = {}
            for r in db.execute(f"PRAGMA foreign_key_list({quoted})"):
                by_id.setdefault(r[0], []).append(r)
            for rows in by_id.values():
                made.references.append((name, tuple(r[3] for r in rows), rows[0][2], tuple(r[4] for r in rows)))
        return made
    finally:
        db.close()


def read_duckdb(spark: SparkSession, path: str) -> Snapshot:
    """A local DuckDB file, table by table through Arrow."""
    import duckdb

    db = duckdb.connect(path, read_only=True)
    try:
        names = [r[0] for r in db.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' AND table_type = 'BASE TABLE' ORDER BY 1").fetchall()]
        made = Snapshot({})
        for name in names:
            quoted = '"' + name.replace('"', '""') + '"'
            made.tables[name] = spark.createDataFrame(db.execute(f"SELECT * FROM {quoted}").fetch_df())
        for table, columns in db.execute("SELECT table_name, constraint_column_names FROM duckdb_constraints() WHERE constraint_type = 'PRIMARY KEY'").fetchall():
            made.keys[table] = tuple(columns)
        return made
    finally:
        db.close()
