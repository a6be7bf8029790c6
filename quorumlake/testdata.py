"""The shared test tables as a release: keys, relationships and what is declared about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.model import ColumnDef, Coverage, Endpoint, Relationship, Release, TableDef, table_from

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

RELATIONSHIPS = (
    Relationship("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    Relationship("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    Relationship("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    Relationship("orders", ("o_custkey",), "customer", ("c_custkey",)),
    Relationship("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    Relationship("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    Relationship("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    Relationship("events", ("user_id",), "customer", ("c_custkey",)),
    Relationship("labels", ("doc_id",), "documents", ("doc_id",), one_to_one=True),
    Relationship("conversations", ("conv_id",), "threads", ("conv_id",)),
)
REL = {r.id: r for r in RELATIONSHIPS}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession, sf_dir: str) -> Release:
    """All relationships are covered for all parents, except that events are listed by nobody."""

    def t(name: str, *key: str, **columns: dict) -> TableDef:
        return table_from(name, read(spark, sf_dir, name), key, columns)

    text = {"datatype": "string"}
    tables = [
        t("region", "r_regionkey"), t("nation", "n_nationkey"), t("customer", "c_custkey", c_name=text, c_acctbal={"units": "1"}), t("supplier", "s_suppkey", s_name=text),
        t("part", "p_partkey", p_name=text, p_size={"units": "cm"}), t("orders", "o_orderkey", o_orderpriority={"permissible": PRIORITIES, "ordered": True}),
        t("lineitem"), t("events", "event_id", props=text), t("documents", "doc_id", text=text), t("labels"),
    ]
    talk = read(spark, sf_dir, "conversations")
    tables += [table_from("conversations", talk, (), {"text": text}), table_from("threads", talk.select("conv_id").distinct(), ("conv_id",))]
    known = {x.name: x for x in tables}
    covered = {r.id: Coverage("all") for r in RELATIONSHIPS if r.child not in ("events",)}
    return Release("tpch", known, RELATIONSHIPS, covered)


def with_listing(made: Release, name: str, frame: DataFrame) -> Release:
    """The release with a coverage table."""
    return Release(made.name, made.tables | {name: table_from(name, frame, (), role="coverage")}, made.relationships, made.coverage, made.endpoints)


def follow_up(spark: SparkSession, sf_dir: str) -> Release:
    """Customers with a time-to-event outcome: days from first to last order, an event if the last one is filled."""
    base = release(spark, sf_dir)
    orders = base.tables["orders"].frame
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))
    spans = orders.groupBy(F.col("o_custkey").alias("_c")).agg(F.min("o_orderdate").alias("_a"), F.max("o_orderdate").alias("_b"), last["o_orderstatus"].alias("last_status"))
    days = F.floor((F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / F.lit(86_400_000_000)).cast("double")
    t = base.tables["customer"]
    frame = t.frame.join(spans, F.col("c_custkey") == F.col("_c"), "left").withColumn("days", days).drop("_a", "_b", "_c")
    columns = t.columns | {"days": ColumnDef("days", "time_offset", "d"), "last_status": ColumnDef("last_status", "category")}
    end = Endpoint("ep:last_order", "days", "last_status", ("F",), ("O", "P"))
    return Release("tpch", base.tables | {"customer": TableDef("customer", frame, columns, t.key)}, base.relationships, base.coverage, {end.id: end})
