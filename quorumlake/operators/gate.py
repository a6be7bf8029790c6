"""The validation gate: what a release declares, checked as queries that count or list offenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.model import NOT_APPLICABLE, Relationship, Release, state_of
from quorumlake.operators.compile import Frame
from quorumlake.operators.truth import FALSE


def _any_null(columns: tuple[str, ...]):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def key_null(frame: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return frame.where(_any_null(key))


def key_not_unique(frame: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, n) of keys met more than once."""
    return frame.where(~_any_null(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(release: Release, rel: Relationship) -> DataFrame:
    """Child rows whose key isn't null and has no parent."""
    child, parent = release.tables[rel.child].frame, release.tables[rel.parent].frame
    keys = parent.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(rel.parent_columns)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(rel.columns)])
    return child.where(~_any_null(rel.columns)).join(keys, on, "left_anti")


def cardinality_violated(release: Release, rel: Relationship) -> DataFrame:
    """Keys that more than one child of a one-to-one relationship has."""
    return key_not_unique(release.tables[rel.child].frame, rel.columns)


def coverage_unknown(release: Release, rel: Relationship) -> DataFrame:
    """Listed parents that don't exist."""
    coverage = release.covered_by(rel)
    listing = release.tables[coverage.table].frame
    keys = release.tables[rel.parent].frame.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(rel.parent_columns)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(coverage.parent_columns)])
    return listing.where(~_any_null(coverage.parent_columns)).join(keys, on, "left_anti")


def coverage_null(release: Release, rel: Relationship) -> DataFrame:
    coverage = release.covered_by(rel)
    return release.tables[coverage.table].frame.where(_any_null(coverage.parent_columns))


def outside_record_filter(release: Release, rel: Relationship) -> DataFrame:
    """Rows of a table that holds only some kinds of rows and aren't of those."""
    child = Frame(release, rel.child)
    truth = child.truth(release.covered_by(rel).record_filter)
    return child.df.where(truth.v == FALSE).select(*release.tables[rel.child].frame.columns)


def not_applicable_in(release: Release, table: str, column: str) -> DataFrame:
    t = release.tables[table]
    return t.frame.where(state_of(t.frame, t.columns[column]) == NOT_APPLICABLE)


def gate(release: Release) -> DataFrame:
    """(check, subject, n): every check that fails, with the number of offending rows or keys."""
    found = []

    def add(check: str, subject: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), F.lit(subject).alias("subject"), "n"))

    for t in release.tables.values():
        if t.key:
            add("KEY_NULL", t.name, key_null(t.frame, t.key))
            add("KEY_NOT_UNIQUE", t.name, key_not_unique(t.frame, t.key))
    for rel in release.relationships:
        add("DANGLING_REFERENCE", rel.id, dangling(release, rel))
        if rel.one_to_one:
            add("CARDINALITY_VIOLATED", rel.id, cardinality_violated(release, rel))
        coverage = release.covered_by(rel)
        if coverage.parents == "direct":
            add("COVERAGE_NULL", rel.id, coverage_null(release, rel))
            add("COVERAGE_UNKNOWN", rel.id, coverage_unknown(release, rel))
        if coverage.record_filter is not None:
            add("OUTSIDE_RECORD_FILTER", rel.id, outside_record_filter(release, rel))
    return reduce(DataFrame.unionByName, found).where("n > 0")
