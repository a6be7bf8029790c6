"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from quorumlake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import os

    made = duckdb.connect()
    for f in os.listdir(SF):
        made.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return made


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    out = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = db.execute(SQL[name]).fetchdf()
        assert sorted(out.columns) == sorted(want.columns)
        assert normal(out) == normal(want)


def test_date_difference_in_another_zone(spark, db):
    """Summer time of the session's zone is no part of a difference between days."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = QUERIES["derived_date_diff"](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert normal(out) == normal(db.execute(SQL["derived_date_diff"]).fetchdf())


def test_entry(spark):
    assert driver.entry(spark).first().asDict() == {"n_true": 34, "n_false": 116, "n_unknown": 0}


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
