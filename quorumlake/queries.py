"""Queries over the shared tables, one for each operator that has a form in SQL, beside that form."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake import disclosure, testdata
from quorumlake.engine import Engine
from quorumlake.functions import cells, derive, stats, survival
from quorumlake.model import Coverage, Release, with_states
from quorumlake.operators import counts, gate, infer
from quorumlake.operators.compile import Frame
from quorumlake.operators.truth import TRUE
from quorumlake.operators.variables import joint, memberships, rows_distribution, variable
from quorumlake.plans.document import parse
from quorumlake.plans.graph import path_to
from quorumlake.plans.resolve import Resolver

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ORDERS, LINES, EVENTS, LABELS, TALK = "rel:orders.o_custkey", "rel:lineitem.l_orderkey", "rel:events.user_id", "rel:labels.doc_id", "rel:conversations.conv_id"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def doc(unit: str, views: list | None = None, **cohorts: Any) -> dict:
    return {"dataset": "tpch", "unit": unit, "cohorts": cohorts, "views": views or []}


def value(column: str, **rest: Any) -> dict:
    return {"kind": "value", "column": column, **rest}


#: The tables' graph has several ways between most tables, so a question names its own.
STRAIGHT = {"orders": [ORDERS], "lineitem": [LINES]}


def exists(table: str, *where: dict, **rest: Any) -> dict:
    if table in STRAIGHT:
        rest.setdefault("via", STRAIGHT[table])
    return {"kind": "exists", "table": table, "where": list(where), **rest}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(testdata.release(spark, sf_dir))


def answers(made: Release, unit: str, key: str, clause: dict) -> DataFrame:
    """(key, v): each unit's answer."""
    got = Engine(made).answers(doc(unit, a=clause))
    return got.select(key, F.col("a_v").alias("v"))


def reasoned(made: Release, unit: str, key: str, clause: dict) -> DataFrame:
    got = Engine(made).answers(doc(unit, a=clause))
    return got.select(key, F.col("a_v").alias("v"), F.col("a_r").alias("r"))


BIG = value("orders.o_totalprice", range={"gt": 100000})
FLAGSHIP = {"all": [value("customer.c_mktsegment", values=["BUILDING"]), exists("orders", BIG, min_count=3)]}


@query("""SELECT count(*) FILTER (WHERE v) AS n_true, count(*) FILTER (WHERE NOT v) AS n_false, CAST(0 AS BIGINT) AS n_unknown
FROM (SELECT c_mktsegment = 'BUILDING' AND coalesce(n, 0) >= 3 AS v FROM customer LEFT JOIN
(SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).count(doc("customer", a=FLAGSHIP), "a").select("n_true", "n_false", "n_unknown")


# Leaves


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def value_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a=value("customer.c_mktsegment", values=["BUILDING", "MACHINERY"])), "a").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("orders", a=value("orders.o_totalprice", range={"gt": 100000, "lte": 150000})), "a").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING')")
def value_negate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a=value("customer.c_mktsegment", values=["BUILDING"], negate=True)), "a").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def value_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("orders", a=value("orders.o_orderdate", range={"gte": "1996-01-01T00:00:00", "lt": "1997-01-01T00:00:00"})), "a").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 5000")
def value_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units({**doc("customer", a=value("customer.c_acctbal", op=">=", value="$floor")), "params": {"floor": 5000}}, "a").select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 2 ELSE 0 END AS v FROM orders")
def ordered_category_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(testdata.release(spark, sf_dir), "orders", "o_orderkey", value("orders.o_orderpriority", range={"lte": "3-MEDIUM"}))


def coded(spark: SparkSession, sf_dir: str) -> Release:
    """Two codes of the orders' priority and status stand for missing values."""
    made = testdata.release(spark, sf_dir)
    made = made.declare("orders", "o_orderpriority", missing=(("4-NOT SPECIFIED", "UNKNOWN"),))
    return made.declare("orders", "o_orderstatus", missing=(("P", "NOT_APPLICABLE"),))


@query("""SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE 'PRESENT' END AS state, count(*) AS n FROM orders GROUP BY 1""")
def missing_code_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).tables["orders"].frame.groupBy(F.col("o_orderpriority__state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS v FROM orders")
def not_applicable_is_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(coded(spark, sf_dir), "orders", "o_orderkey", value("orders.o_orderstatus", values=["F"]))


_ANY = "least(greatest(p, s), 2 - t)"


@query(f"""WITH c AS (SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END AS p,
CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS s, CASE WHEN o_totalprice > 150000 THEN 2 ELSE 0 END AS t FROM orders)
SELECT count(*) FILTER (WHERE {_ANY} = 2) AS n_true, count(*) FILTER (WHERE {_ANY} = 0) AS n_false, count(*) FILTER (WHERE {_ANY} = 1) AS n_unknown,
count(*) FILTER (WHERE {_ANY} = 1) AS u_no_information FROM c""")
def all_any_not_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    clause = {"all": [{"any": [value("orders.o_orderpriority", values=["1-URGENT"]), value("orders.o_orderstatus", values=["F"])]}, {"not": value("orders.o_totalprice", range={"gt": 150000})}]}
    return Engine(coded(spark, sf_dir)).count(doc("orders", a=clause), "a").select("n_true", "n_false", "n_unknown", "u_no_information")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0 ELSE 2 END AS known, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 2 ELSE 0 END AS unknown FROM orders")
def known_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = value("orders.o_orderpriority", values=["1-URGENT"])
    got = Engine(coded(spark, sf_dir)).answers(doc("orders", k={"known": leaf}, u={"unknown": leaf}))
    return got.select("o_orderkey", F.col("k_v").alias("known"), F.col("u_v").alias("unknown"))


@query("SELECT p_partkey FROM part WHERE p_size > 0.2 * 100")
def units_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("part", a=value("part.p_size", range={"gt": 0.2}, units="m")), "a").select("p_partkey")


def _worded(spark: SparkSession, sf_dir: str) -> Release:
    """Parts with the words of their names as a list."""
    made = testdata.release(spark, sf_dir)
    part = made.tables["part"].frame.withColumn("words", F.split("p_type", " "))
    part = part.withColumn("words__item_state", F.transform("words", lambda w: F.when(F.length(w) == 3, "NOT_ASSESSED").otherwise("PRESENT")))
    made.tables["part"] = testdata.table_from("part", part.select(*[c for c in part.columns if c != "words__item_state"]), ("p_partkey",))
    made.tables["part"].frame = part
    return made


_ITEMS = "SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda w: CASE WHEN length(w) = 3 THEN 1 WHEN w IN ('PROMO', 'STEEL', 'STANDARD') THEN 2 ELSE 0 END) AS c FROM part"


@query(f"SELECT p_partkey, list_max(c) AS v FROM ({_ITEMS})")
def list_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(_worded(spark, sf_dir), "part", "p_partkey", value("part.words", values=["PROMO", "STEEL", "STANDARD"], match="any"))


@query(f"SELECT p_partkey, list_min(c) AS v FROM ({_ITEMS})")
def list_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(_worded(spark, sf_dir), "part", "p_partkey", value("part.words", values=["PROMO", "STEEL", "STANDARD"], match="all"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def lookup_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a=value("nation.n_regionkey", values=[1, 3], via=["rel:customer.c_nationkey"])), "a").select("c_custkey")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA')")
def lookup_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    via = ["rel:customer.c_nationkey", "rel:nation.n_regionkey"]
    return engine(spark, sf_dir).units(doc("customer", a=value("region.r_name", values=["ASIA"], via=via)), "a").select("c_custkey")


@query("SELECT c_custkey, CASE WHEN n.n_nationkey IS NULL THEN 1 WHEN n.n_regionkey = 1 THEN 2 ELSE 0 END AS v, CASE WHEN n.n_nationkey IS NULL THEN 8 ELSE 0 END AS r FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey")
def lookup_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    made.tables["nation"].frame = made.tables["nation"].frame.where("n_nationkey < 20")
    return reasoned(made, "customer", "c_custkey", value("nation.n_regionkey", values=[1], via=["rel:customer.c_nationkey"]))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (1, 5, 7, 100000000)")
def ids_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a={"kind": "ids", "ids": [1, 5, 7, 100000000]}), "a").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey < 400 AND c_custkey % 1 = 0")
def ids_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a={"kind": "ids", "ids": list(range(-10, 400))}), "a").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING')")
def cohort_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc("customer", a=value("customer.c_mktsegment", values=["BUILDING"]), b={"all": [{"not": {"kind": "cohort", "cohort": "a"}}]})
    return engine(spark, sf_dir).units(d, "b").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 9000 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def pack_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def wealthy(leaf: dict) -> dict:
        return {"all": [value("customer.c_acctbal", range={"gte": leaf["floor"]}), value("customer.c_mktsegment", values=leaf["segments"])]}

    made = Engine(testdata.release(spark, sf_dir), {"shop.wealthy": wealthy})
    return made.units(doc("customer", a={"kind": "shop.wealthy", "floor": 9000, "segments": ["BUILDING", "AUTOMOBILE"]}), "a").select("c_custkey")


# Set operations on cohorts

_A, _B = value("customer.c_mktsegment", values=["BUILDING", "MACHINERY"]), value("customer.c_acctbal", range={"gt": 4000})
_SQL_A, _SQL_B = "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_acctbal > 4000"


@query(f"SELECT c_custkey, CASE WHEN {_SQL_A} AND {_SQL_B} THEN 2 ELSE 0 END AS both, CASE WHEN {_SQL_A} OR {_SQL_B} THEN 2 ELSE 0 END AS either, CASE WHEN {_SQL_A} AND NOT {_SQL_B} THEN 2 ELSE 0 END AS less FROM customer")
def cohort_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = {"kind": "cohort", "cohort": "a"}, {"kind": "cohort", "cohort": "b"}
    got = engine(spark, sf_dir).answers(doc("customer", a=_A, b=_B, both={"all": [a, b]}, either={"any": [a, b]}, less={"all": [a, {"not": b}]}))
    return got.select("c_custkey", *[F.col(f"{n}_v").alias(n) for n in ("both", "either", "less")])


# Existence


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000)")
def exists_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a=exists("orders", value("orders.o_totalprice", range={"gt": 180000}))), "a").select("c_custkey")


@query("SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) >= 5")
def exists_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("customer", a=exists("orders", BIG, quantifier={"some": 5})), "a").select("c_custkey")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 1 WHEN ok = n THEN 2 ELSE 0 END AS v, CASE WHEN n IS NULL THEN 32 ELSE 0 END AS r FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 20000) AS ok FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def exists_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(testdata.release(spark, sf_dir), "customer", "c_custkey", exists("orders", value("orders.o_totalprice", range={"gt": 20000}), quantifier="every"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).units(doc("orders", a={"not": exists("lineitem", value("lineitem.l_quantity", range={"gt": 25}))}), "a").select("o_orderkey")


_TWO = """SELECT c_custkey, CASE WHEN coalesce(t, 0) >= 1 THEN 2 WHEN coalesce(n, 0) > 0 THEN 0 ELSE 1 END AS v FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE big >= 3) AS t FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 45) AS big FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey"""


@query(_TWO)
def exists_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = exists("lineitem", value("lineitem.l_quantity", range={"gt": 45}), via=[ORDERS, LINES], quantifier=["some", {"some": 3}])
    return answers(testdata.release(spark, sf_dir), "customer", "c_custkey", leaf)


@query("SELECT c_custkey, CASE WHEN n > 0 THEN 2 ELSE 1 END AS v, CASE WHEN n > 0 THEN 0 ELSE 4 END AS r FROM (SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') ON user_id = c_custkey GROUP BY 1)")
def exists_undeclared_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(testdata.release(spark, sf_dir), "customer", "c_custkey", exists("events", value("events.event_type", values=["purchase"])))


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer JOIN orders x ON x.o_custkey = c_custkey WHERE c_custkey = orders.o_custkey AND x.o_totalprice > 190000) THEN 2 ELSE 0 END AS v FROM orders")
def exists_after_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an order up to its customer and down to all of the customer's orders."""
    leaf = exists("orders", value("orders.o_totalprice", range={"gt": 190000}), via=[ORDERS, ORDERS])
    return answers(testdata.release(spark, sf_dir), "orders", "o_orderkey", leaf)


@query("SELECT o_orderkey, CASE WHEN sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) - CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END >= 1 THEN 2 ELSE 0 END AS v FROM orders")
def exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = exists("orders", value("orders.o_totalprice", range={"gt": 150000}), via=[ORDERS, ORDERS], exclude_self=True)
    return answers(testdata.release(spark, sf_dir), "orders", "o_orderkey", leaf)


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 45) THEN 2 ELSE 0 END AS v FROM orders")
def exists_trailing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = value("part.p_size", range={"gt": 45}, via=[LINES, "rel:lineitem.l_partkey"])
    return answers(testdata.release(spark, sf_dir), "orders", "o_orderkey", leaf)


# Coverage


@query("SELECT documents.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 WHEN toxic = 1 THEN 2 ELSE 0 END AS v, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 0 END AS r FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = documents.doc_id")
def coverage_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    made = testdata.with_listing(made, "labelled", testdata.read(spark, sf_dir, "labels").select("doc_id"))
    made = made.cover(LABELS, Coverage("direct", "labelled", ("doc_id",)))
    return reasoned(made, "documents", "doc_id", exists("labels", value("labels.toxic", values=[1])))


def scoped(spark: SparkSession, sf_dir: str) -> Release:
    """Customers' events are listed by type: those up to 100 for purchases and clicks, those up to 120 for clicks."""
    made = testdata.release(spark, sf_dir)
    users = testdata.read(spark, sf_dir, "customer").where("c_custkey <= 120").select("c_custkey")
    types = F.when(F.col("c_custkey") <= 100, F.array(F.lit("purchase"), F.lit("click"))).otherwise(F.array(F.lit("click")))
    made = testdata.with_listing(made, "watched", users.select(F.col("c_custkey").alias("who"), F.explode(types).alias("what")))
    return made.cover(EVENTS, Coverage("direct", "watched", ("who",), (("event_type", "what"),)))


_SCOPED = "SELECT c_custkey, CASE WHEN n > 0 THEN 2 WHEN c_custkey <= {0} THEN 0 ELSE 1 END AS v FROM (SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN (SELECT * FROM events WHERE {1}) ON user_id = c_custkey GROUP BY 1)"


@query(_SCOPED.format(100, "event_type IN ('purchase', 'click') AND value > 95"))
def coverage_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = exists("events", value("events.event_type", values=["purchase", "click"]), value("events.value", range={"gt": 95}))
    return answers(scoped(spark, sf_dir), "customer", "c_custkey", leaf)


@query(_SCOPED.format(120, "value > 99"))
def coverage_scope_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(scoped(spark, sf_dir), "customer", "c_custkey", exists("events", value("events.value", range={"gt": 99})))


def grouped(spark: SparkSession, sf_dir: str) -> Release:
    """Customers are assigned to groups by their nation; even groups cover all event types, odd ones purchases."""
    made = testdata.release(spark, sf_dir)
    customer = testdata.read(spark, sf_dir, "customer")
    plan = spark.range(25).select(F.col("id").cast("int").alias("plan"), F.when(F.col("id") % 2 == 1, "purchase").alias("what"), (F.col("id") % 2 == 0).alias("whole"))
    made = testdata.with_listing(made, "assigned", customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("who"), F.col("c_nationkey").alias("plan")))
    made = testdata.with_listing(made, "plans", plan)
    return made.cover(EVENTS, Coverage("grouped", "assigned", ("who",), (("event_type", "what"),), "plan", "plans", "plan", "whole"))


@query("SELECT c_custkey, CASE WHEN n > 0 THEN 2 WHEN c_nationkey < 20 AND c_nationkey % 2 = 0 THEN 0 ELSE 1 END AS v FROM (SELECT c_custkey, c_nationkey, count(event_id) AS n FROM customer LEFT JOIN (SELECT * FROM events WHERE event_type = 'click' AND value > 95) ON user_id = c_custkey GROUP BY 1, 2)")
def coverage_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = exists("events", value("events.event_type", values=["click"]), value("events.value", range={"gt": 95}))
    return answers(grouped(spark, sf_dir), "customer", "c_custkey", leaf)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 WHEN n > 0 THEN 2 ELSE 0 END AS v, CASE WHEN o_orderstatus = 'P' THEN 16 ELSE 0 END AS r FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def parent_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    scope = Resolver(made, "orders").clause(value("orders.o_orderstatus", values=["F", "O"]), "orders")
    made = made.cover(LINES, Coverage("all", parent_scope=scope))
    return reasoned(made, "orders", "o_orderkey", exists("lineitem", value("lineitem.l_quantity", range={"gt": 45})))


@query("SELECT o_orderkey, CASE WHEN n IS NULL THEN 1 WHEN bad > 0 THEN 0 ELSE 2 END AS v FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND NOT l_quantity > 20) AS bad FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    kind = Resolver(made, "orders").clause(value("lineitem.l_returnflag", values=["R"]), "lineitem")
    made = made.cover(LINES, Coverage("all", record_filter=kind))
    return answers(made, "orders", "o_orderkey", exists("lineitem", value("lineitem.l_quantity", range={"gt": 20}), quantifier="every"))


@query("SELECT c_custkey, CASE WHEN c_custkey <= 100 THEN 2 ELSE 0 END AS both, CASE WHEN c_custkey <= 120 THEN 2 ELSE 0 END AS clicks, CASE WHEN c_custkey <= 120 THEN 2 ELSE 0 END AS anything FROM customer")
def covered_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = {"kind": "covered", "table": "events"}
    got = Engine(scoped(spark, sf_dir)).answers(doc("customer", both=leaf | {"scope": {"event_type": ["purchase", "click"]}}, clicks=leaf | {"scope": {"event_type": ["click"]}}, anything=leaf))
    return got.select("c_custkey", *[F.col(f"{n}_v").alias(n) for n in ("both", "clicks", "anything")])


def lifted(spark: SparkSession, sf_dir: str) -> Release:
    """Lines are known for orders that aren't pending, and listed for orders under a price."""
    made = testdata.release(spark, sf_dir)
    made = testdata.with_listing(made, "checked", testdata.read(spark, sf_dir, "orders").where("o_totalprice < 120000").select(F.col("o_orderkey").alias("k")))
    scope = Resolver(made, "orders").clause(value("orders.o_orderstatus", values=["F", "O"]), "orders")
    return made.cover(LINES, Coverage("direct", "checked", ("k",), parent_scope=scope))


_LIFT = """WITH o AS (SELECT o_custkey, o_orderstatus = 'P' AS oos, count(l_orderkey) > 0 AS hit, o_totalprice < 120000 AS listed FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice),
p AS (SELECT o_custkey, count(*) FILTER (WHERE NOT oos AND hit) AS t, count(*) FILTER (WHERE NOT oos AND NOT hit AND listed) AS f, count(*) FILTER (WHERE NOT oos AND NOT hit AND NOT listed) AS nc FROM o GROUP BY 1)
"""
_STRICT = "CASE WHEN coalesce(t, 0) > 0 THEN 2 WHEN coalesce(nc, 0) > 0 THEN 1 WHEN coalesce(f, 0) > 0 THEN 0 ELSE 1 END"
_ASSESSED = "CASE WHEN coalesce(t, 0) > 0 THEN 2 WHEN coalesce(f, 0) > 0 THEN 0 ELSE 1 END"


def _lift_clause(lift: str) -> dict:
    return exists("lineitem", value("lineitem.l_quantity", range={"gt": 48}), via=[ORDERS, LINES], lift=lift)


@query(_LIFT + f"SELECT c_custkey, {_STRICT} AS v FROM customer LEFT JOIN p ON o_custkey = c_custkey")
def lift_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(lifted(spark, sf_dir), "customer", "c_custkey", _lift_clause("strict"))


@query(_LIFT + f"SELECT c_custkey, {_ASSESSED} AS v FROM customer LEFT JOIN p ON o_custkey = c_custkey")
def lift_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(lifted(spark, sf_dir), "customer", "c_custkey", _lift_clause("assessed"))


@query(_LIFT + f"SELECT count(*) FILTER (WHERE {_STRICT} <> {_ASSESSED}) AS lift_differs FROM customer LEFT JOIN p ON o_custkey = c_custkey")
def lift_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(lifted(spark, sf_dir)).count(doc("customer", a=_lift_clause("strict")), "a").select("lift_differs")


# Crossings and counts

_VIEW = {"analysis": "compare.existence", "cohorts": ["a", "b"], "reference": "b", "params": {"predicates": [value("customer.c_mktsegment", values=["BUILDING"]), exists("orders", BIG, min_count=5)]}}
_POOR, _RICH = value("customer.c_acctbal", range={"lt": 3000}), value("customer.c_acctbal", range={"gte": 3000})
_CROSS = """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1),
u AS (SELECT CASE WHEN c_acctbal < 3000 THEN 'a' ELSE 'b' END AS cohort, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END AS p0, CASE WHEN coalesce(n, 0) >= 5 THEN 2 ELSE 0 END AS p1 FROM customer LEFT JOIN o ON o_custkey = c_custkey)
"""


@query(_CROSS + "SELECT cohort, 0 AS predicate, p0 AS v, 0 AS r, count(*) AS n FROM u GROUP BY 1, 3 UNION ALL SELECT cohort, 1, p1, 0, count(*) FROM u GROUP BY 1, 3")
def crossing_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).existence_counts(parse(doc("customer", [_VIEW], a=_POOR, b=_RICH)), _VIEW)


@query(f"SELECT 'a' AS a, 'b' AS b, count(*) FILTER (WHERE {_SQL_A} AND {_SQL_B}) AS n FROM customer")
def shared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, frame, clauses = engine(spark, sf_dir).cohorts(doc("customer", a=_A, b=_B))
    return counts.shared_units(frame, clauses)


def _proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predicate, k, n, cohort) of the crossing."""
    got = crossing_grouping_sets(spark, sf_dir)
    return got.groupBy("cohort", "predicate").agg(F.sum(F.when(F.col("v") == TRUE, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("v") != 1, F.col("n")).otherwise(0)).alias("n"))


def _rounded(c: Column) -> Column:
    return F.round(c, 6)


_Z = stats.z_of(0.95)
_PK = _CROSS + ", t AS (SELECT cohort, 0 AS predicate, count(*) FILTER (WHERE p0 = 2) AS k, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT cohort, 1, count(*) FILTER (WHERE p1 = 2), count(*) FROM u GROUP BY 1), w AS (SELECT *, k / n AS p, {z} * {z} / (2 * n) AS h FROM t), i AS (SELECT *, (p + h - {z} * sqrt(p * (1 - p) / n + h / (2 * n))) / (1 + 2 * h) AS lo, (p + h + {z} * sqrt(p * (1 - p) / n + h / (2 * n))) / (1 + 2 * h) AS hi FROM w) ".replace("{z}", repr(_Z))


def _existence(spark: SparkSession, sf_dir: str) -> list[dict]:
    return engine(spark, sf_dir).compare_existence(parse(doc("customer", [_VIEW], a=_POOR, b=_RICH)), _VIEW)["predicates"]


@query(_PK + "SELECT cohort, predicate, k, n, round(lo, 6) AS low, round(hi, 6) AS high FROM i")
def existence_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, i, r["k"], r["n"], round(r["interval"][0], 6), round(r["interval"][1], 6)) for i, p in enumerate(_existence(spark, sf_dir)) for c, r in p["cohorts"].items()]
    return spark.createDataFrame(rows, "cohort string, predicate int, k long, n long, low double, high double")


@query(_PK + "SELECT a.predicate, round(a.p - b.p, 6) AS difference, round(a.p - b.p - sqrt((a.p - a.lo) ** 2 + (b.hi - b.p) ** 2), 6) AS low, round(a.p - b.p + sqrt((a.hi - a.p) ** 2 + (b.p - b.lo) ** 2), 6) AS high FROM i a JOIN i b ON a.predicate = b.predicate WHERE a.cohort = 'a' AND b.cohort = 'b'")
def risk_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *(round(x, 6) for x in p["risk_difference"])) for i, p in enumerate(_existence(spark, sf_dir))]
    return spark.createDataFrame(rows, "predicate int, difference double, low double, high double")


@query(_PK + f"SELECT a.predicate, round(a.p / b.p, 6) AS ratio, round(a.p / b.p * exp(-{_Z!r} * sqrt(1 / a.k - 1 / a.n + 1 / b.k - 1 / b.n)), 6) AS low, round(a.p / b.p * exp({_Z!r} * sqrt(1 / a.k - 1 / a.n + 1 / b.k - 1 / b.n)), 6) AS high FROM i a JOIN i b ON a.predicate = b.predicate WHERE a.cohort = 'a' AND b.cohort = 'b'")
def risk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *(round(x, 6) for x in p["risk_ratio"])) for i, p in enumerate(_existence(spark, sf_dir))]
    return spark.createDataFrame(rows, "predicate int, ratio double, low double, high double")


_FISHER = """, f AS (SELECT a.predicate, a.k AS a, a.n - a.k AS b, b.k AS c, b.n - b.k AS d FROM t a JOIN t b ON a.predicate = b.predicate WHERE a.cohort = 'a' AND b.cohort = 'b'),
x AS (SELECT *, unnest(generate_series(greatest(0, a + c - (b + d) - a - c + a + b - (a + b) + (a + b) + (a + c) - (a + b + c + d) - (a + c) + (b + d)), least(a + b, a + c))) AS x FROM f),
g AS (SELECT *, lgamma(x + 1) + lgamma(a + b - x + 1) + lgamma(a + c - x + 1) + lgamma(d - a + x + 1) AS e, lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) AS e0 FROM x WHERE d - a + x >= 0)
"""


@query(_PK + _FISHER + "SELECT predicate, round(sum(exp(e0 - e)) FILTER (WHERE e0 - e <= 1e-7) / sum(exp(e0 - e)), 6) AS p FROM g GROUP BY 1")
def fisher_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, round(p["p"], 6)) for i, p in enumerate(_existence(spark, sf_dir))], "predicate int, p double")


_SEGMENTS = doc("customer", **{s.lower(): value("customer.c_mktsegment", values=[s]) for s in ("BUILDING", "AUTOMOBILE", "MACHINERY")})
_CHI_VIEW = {"analysis": "compare.existence", "params": {"predicates": [value("customer.c_acctbal", range={"gt": x}) for x in (1000, 4000, 7000)]}}
_CHI = """WITH t AS (SELECT i AS predicate, c_mktsegment AS s, count(*) FILTER (WHERE c_acctbal > x) AS k, count(*) AS n FROM customer, (VALUES (0, 1000), (1, 4000), (2, 7000)) v(i, x) WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') GROUP BY 1, 2),
e AS (SELECT *, n * (sum(k) OVER (PARTITION BY predicate)) / sum(n) OVER (PARTITION BY predicate) AS ek FROM t),
chi AS (SELECT predicate, sum((k - ek) ** 2 / ek + (k - ek) ** 2 / (n - ek)) AS x FROM e GROUP BY 1)
"""


def _chi(spark: SparkSession, sf_dir: str) -> list[dict]:
    return engine(spark, sf_dir).compare_existence(parse(_SEGMENTS), _CHI_VIEW)["predicates"]


@query(_CHI + "SELECT predicate, round(x, 6) AS chi2, round(exp(-x / 2), 6) AS p FROM chi")
def chi_squared_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, round(p["chi2"], 6), round(p["p"], 6)) for i, p in enumerate(_chi(spark, sf_dir))], "predicate int, chi2 double, p double")


@query(_CHI + "SELECT predicate, round(least(1, min(p * 3 / rank) OVER (ORDER BY rank DESC)), 6) AS q FROM (SELECT predicate, exp(-x / 2) AS p, row_number() OVER (ORDER BY x DESC) AS rank FROM chi)")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, round(p["q"], 6)) for i, p in enumerate(_chi(spark, sf_dir))], "predicate int, q double")


# Variables


def _var(made: Release, unit: str, spec: dict, cohort: dict | None = None) -> tuple[Frame, Column, Any]:
    if "aggregate" in spec:
        spec = {"via": [ORDERS]} | spec
    d = parse(doc(unit, a=cohort or {"all": []}))
    _, frame, clauses = Engine(made).cohorts(d)
    members = frame.truth(clauses["a"]).v == TRUE
    return frame, members, variable(frame, spec, Resolver(made, unit, d.cohorts))


def _per_unit(made: Release, unit: str, key: str, spec: dict) -> DataFrame:
    frame, members, v = _var(made, unit, spec)
    return frame.df.where(members).select(key, v.x.cast("int").alias("x"), v.val.alias("val"))


@query("SELECT c_custkey, 0 AS x, c_mktsegment AS val FROM customer")
def var_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"column": "customer.c_mktsegment"})


@query("SELECT c_custkey, 0 AS x, count(o_orderkey) AS val FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON o_custkey = c_custkey GROUP BY 1")
def var_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"aggregate": "count", "table": "orders", "where": [BIG]})


def _extreme(f: str) -> str:
    return f"SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 32 ELSE 0 END AS x, {f}(o_totalprice) AS val FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON o_custkey = c_custkey GROUP BY 1"


_DEAR = value("orders.o_totalprice", range={"gt": 150000})


@query(_extreme("max"))
def var_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"aggregate": "max", "column": "orders.o_totalprice", "where": [_DEAR]})


@query(_extreme("min"))
def var_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"aggregate": "min", "column": "orders.o_totalprice", "where": [_DEAR]})


@query("SELECT c_custkey, round(avg(o_totalprice), 8) AS val FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def var_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, members, v = _var(testdata.release(spark, sf_dir), "customer", {"aggregate": "mean", "column": "orders.o_totalprice"})
    return frame.df.where(members & (v.x == 0)).select("c_custkey", F.round(v.val.cast("double"), 8).alias("val"))


@query("SELECT c_custkey, 0 AS x, coalesce(max(o_totalprice > 190000), false) AS val FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def var_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"aggregate": "some", "column": "orders.o_totalprice", "range": {"gt": 190000}})


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 32 ELSE 0 END AS x, min(o_totalprice > 10000) AS val FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def var_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"aggregate": "every", "column": "orders.o_totalprice", "range": {"gt": 10000}})


@query(_extreme("max").replace("CASE WHEN count(o_orderkey) = 0 THEN 32 ELSE 0 END", "0").replace("max(o_totalprice)", "coalesce(max(o_totalprice), 0)"))
def var_empty_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_unit(testdata.release(spark, sf_dir), "customer", "c_custkey", {"aggregate": "max", "column": "orders.o_totalprice", "where": [_DEAR], "empty": 0.0})


@query("SELECT l_returnflag AS val, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 10 GROUP BY 1")
def rows_distribution_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    d = parse(doc("customer", a=value("customer.c_mktsegment", values=["BUILDING"])))
    _, frame, clauses = Engine(made).cohorts(d)
    where = (Resolver(made, "customer").clause(value("lineitem.l_quantity", range={"gt": 10}), "lineitem"),)
    return rows_distribution(frame, frame.truth(clauses["a"]).v == TRUE, path_to(made, "customer", "lineitem", [ORDERS, LINES]), "l_returnflag", where)


@query("SELECT o_orderpriority AS category, count(DISTINCT o_custkey) AS n_true, (SELECT count(*) FROM customer) AS n_known FROM orders GROUP BY 1")
def memberships_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    _, frame, clauses = Engine(made).cohorts(doc("customer", a={"all": []}))
    return memberships(frame, frame.truth(clauses["a"]).v == TRUE, path_to(made, "customer", "orders", [ORDERS])[0], "o_orderpriority", testdata.PRIORITIES)


@query("SELECT event_type AS category, count(DISTINCT user_id) AS n_true, count(DISTINCT user_id) AS n_known FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def memberships_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where nothing says for whom events are known, only those who have some are."""
    made = testdata.release(spark, sf_dir)
    _, frame, clauses = Engine(made).cohorts(doc("customer", a={"all": []}))
    return memberships(frame, frame.truth(clauses["a"]).v == TRUE, path_to(made, "customer", "events")[0], "event_type")


@query("SELECT o_custkey AS c_custkey, round(avg(l_quantity), 8) AS val FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def pooled_two_step_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, members, v = _var(testdata.release(spark, sf_dir), "customer", {"aggregate": "mean", "column": "lineitem.l_quantity", "via": [ORDERS, LINES]})
    return frame.df.where(members & (v.x == 0)).select("c_custkey", F.round(v.val.cast("double"), 8).alias("val"))


@query("SELECT count(*) FILTER (WHERE p IS NOT NULL OR e > 0) AS n_any, count(*) FILTER (WHERE p IS NULL AND e IS NULL) AS n_none FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_totalprice > 195000 GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey")
def joint_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    frame, members, a = _var(made, "customer", {"aggregate": "max", "column": "orders.o_totalprice", "where": [value("orders.o_totalprice", range={"gt": 195000})]})
    b = variable(frame, {"question": exists("events", value("events.event_type", values=["purchase"]))}, Resolver(made, "customer"))
    return joint(frame, members, [a, b]).select("n_any", "n_none")


# Analyses


def _weighted(spark: SparkSession, sf_dir: str, **cohorts: Any) -> dict[str, list]:
    made = Engine(testdata.release(spark, sf_dir))
    d = parse(doc("orders", **cohorts))
    frame, truths, (v,) = made.values_of(d, {"params": {"variables": [{"column": "orders.o_totalprice"}]}})
    return {n: [(float(x), k) for x, k in made._weighted(frame, t, v)[0]] for n, t in truths.items()}


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F'")
def summary_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In Spark: sums, quartiles and extremes of one pass."""
    frame, members, v = _var(testdata.release(spark, sf_dir), "orders", {"column": "orders.o_totalprice"}, value("orders.o_orderstatus", values=["F"]))
    x, quarter = F.col("x"), F.percentile(F.col("x"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = frame.df.where(members & (v.x == 0)).select(v.val.alias("x")).agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), quarter.alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return got.select("n", "mean", "sd", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)], "lo", "hi")


@query("SELECT o_orderpriority AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def summary_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Engine(testdata.release(spark, sf_dir))
    view = {"params": {"variables": [{"column": "orders.o_orderpriority"}]}}
    got = made.summary_distribution(parse(doc("orders", a=value("orders.o_orderstatus", values=["F"]))), view)["variables"][0]["a"]["shares"]
    return spark.createDataFrame([(c, s["k"], round(s["share"], 6)) for c, s in got.items()], "category string, n long, share double")


@query("SELECT b AS bin, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 150000 THEN 2 WHEN o_totalprice <= 200000 THEN 3 ELSE 4 END AS b FROM orders) GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins closed on the left, the last one on both sides; what is beyond them after it."""
    frame, members, v = _var(testdata.release(spark, sf_dir), "orders", {"column": "orders.o_totalprice"})
    edges = (50000.0, 100000.0, 150000.0)
    bin_ = F.when(v.val > 200000, 4).otherwise(sum((F.when(v.val >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    return frame.df.where(members & (v.x == 0)).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_F, _O = value("orders.o_orderstatus", values=["F"]), value("orders.o_orderstatus", values=["O"])


@query("WITH m AS (SELECT o_orderstatus AS s, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) / count(*) AS v FROM orders GROUP BY 1) SELECT round((a.m - b.m) / sqrt(a.v + b.v), 4) AS t, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1)), 3) AS df FROM m a JOIN m b ON a.s = 'F' AND b.s = 'O'")
def welch_t_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _weighted(spark, sf_dir, f=_F, o=_O)
    w = stats.welch_t(g["f"], g["o"])
    return spark.createDataFrame([(round(w["t"], 4), round(w["df"], 3))], "t double, df double")


_RANKS = "WITH r AS (SELECT o_orderstatus AS s, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS r, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders {}) "


@query(_RANKS.format("") + ", g AS (SELECT s, sum(r) AS rs, count(*) AS n, sum(t * t - 1) AS tie FROM r GROUP BY 1) SELECT round((12 * sum(rs * rs / n) / (sum(n) * (sum(n) + 1)) - 3 * (sum(n) + 1)) / (1 - sum(tie) / (sum(n) ** 3 - sum(n))), 4) AS h FROM g")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _weighted(spark, sf_dir, f=_F, o=_O, p=value("orders.o_orderstatus", values=["P"]))
    return spark.createDataFrame([(round(stats.kruskal_wallis(list(g.values()))["h"], 4),)], "h double")


@query(_RANKS.format("WHERE o_orderstatus IN ('F', 'O')") + "SELECT round(sum(r) - count(*) * (count(*) + 1) / 2, 3) AS w FROM r WHERE s = 'F'")
def mann_whitney_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _weighted(spark, sf_dir, f=_F, o=_O)
    return spark.createDataFrame([(round(stats.mann_whitney(g["f"], g["o"])["w"], 3),)], "w double")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 10")
def members_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).page(parse(doc("customer", a=value("customer.c_mktsegment", values=["BUILDING"]))), "a", 10, 20)


_ENDPOINT = """WITH e AS (SELECT c_mktsegment AS s, CAST(floor(epoch_us(b) / 86400000000.0 - epoch_us(a) / 86400000000.0) AS DOUBLE) AS t, CASE WHEN st = 'F' THEN 1 ELSE 0 END AS e FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
k AS (SELECT s, t, sum(e) AS d, count(*) AS ended FROM e GROUP BY 1, 2),
n AS (SELECT s, t, d, ended - d AS c, sum(ended) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM k),
c AS (SELECT *, CASE WHEN min(n - d) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN n > d THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS surv FROM n WINDOW w AS (PARTITION BY s ORDER BY t))
"""


def _followed(spark: SparkSession, sf_dir: str) -> dict[str, list]:
    made = Engine(testdata.follow_up(spark, sf_dir))
    d = parse(doc("customer", building=value("customer.c_mktsegment", values=["BUILDING"]), machinery=value("customer.c_mktsegment", values=["MACHINERY"])))
    return made.risks(d, ["building", "machinery"], made.release.endpoints["ep:last_order"])


@query(_ENDPOINT + "SELECT lower(s) AS cohort, t AS time, CAST(d AS BIGINT) AS d, CAST(c AS BIGINT) AS c, CAST(n AS BIGINT) AS n FROM n")
def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Engine(testdata.follow_up(spark, sf_dir))
    d = parse(doc("customer", building=value("customer.c_mktsegment", values=["BUILDING"]), machinery=value("customer.c_mktsegment", values=["MACHINERY"])))
    return survival.risk_table(made.endpoint_rows(d, ["building", "machinery"], made.release.endpoints["ep:last_order"]))


@query(_ENDPOINT + "SELECT lower(s) AS cohort, t AS time, round(surv, 6) AS survival FROM c")
def km_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, p["time"], round(p["survival"], 6)) for n, r in _followed(spark, sf_dir).items() for p in survival.kaplan_meier(r)]
    return spark.createDataFrame(rows, "cohort string, time double, survival double")


@query(_ENDPOINT + "SELECT lower(s) AS cohort, CAST(1500 AS DOUBLE) AS time, round(coalesce(min(surv) FILTER (WHERE t <= 1500), 1), 6) AS survival FROM c GROUP BY 1")
def km_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, 1500.0, round(survival.landmark(survival.kaplan_meier(r), 1500)["survival"], 6)) for n, r in _followed(spark, sf_dir).items()]
    return spark.createDataFrame(rows, "cohort string, time double, survival double")


@query(_ENDPOINT + """, x AS (SELECT t, (SELECT count(*) FROM e WHERE s = 'BUILDING' AND e.t >= u.t) AS n1, (SELECT count(*) FROM e WHERE e.t >= u.t) AS nn, (SELECT count(*) FROM e WHERE s = 'BUILDING' AND e.t = u.t AND e = 1) AS d1, (SELECT count(*) FROM e WHERE e.t = u.t AND e = 1) AS dd FROM (SELECT DISTINCT t FROM e WHERE e = 1) u)
SELECT round(sum(d1 - dd * n1 / nn) ** 2 / sum(CASE WHEN nn > 1 THEN dd * (n1 / nn) * (1 - n1 / nn) * (nn - dd) / (nn - 1) ELSE 0 END), 4) AS chi2 FROM x""")
def logrank_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(survival.log_rank(list(_followed(spark, sf_dir).values()))["chi2"], 4),)], "chi2 double")


@query()
def cox_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Engine(testdata.follow_up(spark, sf_dir))
    view = {"params": {"endpoint": "ep:last_order", "variables": [{"column": "customer.c_acctbal"}]}}
    fit = made.survival_cox(parse(doc("customer", a={"all": []})), view)
    return spark.createDataFrame([(fit["n"], fit["events"], fit["beta"][0], fit["se"][0])], "n long, events long, beta double, se double")


# Derived columns and cells


@query("SELECT o_orderkey, round((epoch_us(TIMESTAMP '1998-12-31') - epoch_us(o_orderdate)) / 86400000000.0, 6) AS days FROM orders")
def derived_date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = testdata.read(spark, sf_dir, "orders")
    made = derive.derived(orders, "days", ["o_orderdate"], derive.date_diff(F.col("o_orderdate"), F.lit("1998-12-31").cast("date"), "d"))
    return made.select("o_orderkey", _rounded(F.col("days")).alias("days"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_discount = 0 THEN 'UNKNOWN' ELSE 'PRESENT' END AS state FROM lineitem")
def derived_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testdata.read(spark, sf_dir, "lineitem")
    made = derive.derived(lines, "net", ["l_extendedprice", "l_discount"], derive.arith("*", F.col("l_extendedprice"), derive.arith("-", F.lit(1.0), F.col("l_discount"))))
    made = derive.derived(made, "odd", ["l_discount"], derive.arith("/", F.col("l_extendedprice"), F.col("l_discount")))
    return made.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("net", 4).alias("net"), F.col("odd__state").alias("state"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status FROM orders")
def derived_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = testdata.read(spark, sf_dir, "orders")
    made = derive.derived(orders, "status", ["o_orderstatus"], derive.value_map(F.col("o_orderstatus"), {"F": "filled", "O": "open"}))
    return made.select("o_orderkey", "status")


@query("SELECT p_partkey, round(p_size * 0.01, 6) AS metres FROM part")
def derived_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = testdata.read(spark, sf_dir, "part")
    return derive.derived(part, "metres", ["p_size"], derive.unit_convert(F.col("p_size"), "cm", "m")).select("p_partkey", _rounded(F.col("metres")).alias("metres"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CASE WHEN regexp_extract(props, '[0-9]+') = '' THEN 'UNKNOWN' ELSE 'PRESENT' END AS state FROM events")
def cell_typing_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = testdata.read(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    return cells.typed_column(events, "k", "integer").select("event_id", "k", F.col("k__state").alias("state"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderpriority = '5-LOW' THEN 'NOT_ASSESSED' ELSE 'PRESENT' END AS state FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, NULL, 'NOT_ASSESSED' FROM orders WHERE o_orderpriority = '5-LOW'")
def cell_typing_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderpriority") == "5-LOW", "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = testdata.read(spark, sf_dir, "orders").select("o_orderkey", text.alias("day"))
    return cells.typed_column(orders, "day", "date", {"later": "NOT_ASSESSED"}).select("o_orderkey", F.col("day").cast("string").alias("day"), F.col("day__state").alias("state"))


# Gate, inference, catalogue


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def gate_key_not_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.key_not_unique(testdata.read(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 100)")
def gate_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = testdata.release(spark, sf_dir)
    made.tables["customer"].frame = made.tables["customer"].frame.where("c_custkey < 100")
    return gate.dangling(made, testdata.REL[EVENTS]).select("event_id")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def gate_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.cardinality_violated(testdata.release(spark, sf_dir), testdata.REL[ORDERS])


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
def gate_key_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = testdata.read(spark, sf_dir, "orders").withColumn("k", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return gate.key_null(orders, ("k",)).agg(F.count(F.lit(1)).alias("n"))


@query()
def gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate(testdata.release(spark, sf_dir))


@query("SELECT 'c_custkey' AS \"column\", count(*) = count(DISTINCT c_custkey) AS is_key FROM customer UNION ALL SELECT 'c_nationkey', count(*) = count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_name', count(*) = count(DISTINCT c_name) FROM customer")
def infer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.key_candidates(testdata.read(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_name"])


@query("SELECT count(DISTINCT l_partkey) AS n_values, count(DISTINCT l_partkey) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS n_missing FROM lineitem")
def infer_fk_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.contained(testdata.read(spark, sf_dir, "lineitem"), "l_partkey", testdata.read(spark, sf_dir, "part"), "p_partkey")


@query("SELECT 'o_orderkey' AS \"column\", 'integer' AS datatype UNION ALL SELECT 'o_totalprice', 'number' UNION ALL SELECT 'o_orderpriority', 'category' UNION ALL SELECT 'o_orderstatus', 'category'")
def infer_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.datatypes(testdata.read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"])


@query("SELECT 'o_orderkey' AS \"column\", count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_null, count(DISTINCT o_orderkey) AS \"distinct\", CAST(min(o_orderkey) AS VARCHAR) AS lo, CAST(max(o_orderkey) AS VARCHAR) AS hi FROM orders UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) FILTER (WHERE o_orderpriority IS NULL), count(DISTINCT o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.column_statistics(testdata.read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority"])


@query("SELECT n_name AS gene, sample, v AS call FROM (SELECT n_name, 'r' || r AS sample, CASE WHEN n_regionkey = r THEN CAST(n_nationkey AS VARCHAR) ELSE 'NA' END AS v FROM nation, (VALUES (0), (1), (2), (3), (4)) x(r)) WHERE v <> 'NA'")
def unpivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = testdata.read(spark, sf_dir, "nation")
    matrix = nation.select(F.col("n_name").alias("gene"), *[F.when(F.col("n_regionkey") == r, F.col("n_nationkey").cast("string")).otherwise("NA").alias(f"r{r}") for r in range(5)])
    return infer.unpivoted(matrix, ["gene"], "sample", "call")


# Disclosure


@query()
def suppressed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = engine(spark, sf_dir).count(doc("customer", a=FLAGSHIP), "a").first()
    shown = disclosure.suppressed_counts(row["n_true"], row["n_false"], row["n_unknown"], 50)
    return spark.createDataFrame([shown], "n_true long, n_false long, n_unknown long")


@query()
def merged_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorted((r["bin"], r["n"]) for r in histogram(spark, sf_dir).collect())
    return spark.createDataFrame(disclosure.merged_bins([n for _, n in rows], 100), "first int, last int, n long")


@query("SELECT o_orderkey, o_orderpriority AS val FROM orders ORDER BY 2, 1 LIMIT 50")
def utf16_ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.ids import utf16_order

    return testdata.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("val")).orderBy(utf16_order(F.col("val")), "o_orderkey").limit(50)


@query("WITH s AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events) SELECT user_id, CAST(max(n) AS BIGINT) AS n_sessions FROM (SELECT user_id, 1 + sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s) GROUP BY 1")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = testdata.read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.when(F.col("ts") - F.lag("ts").over(order) > F.expr("INTERVAL 6 HOURS"), 1).otherwise(0)
    return events.select("user_id", apart.alias("b")).groupBy("user_id").agg((F.sum("b") + 1).alias("n_sessions"))


__all__ = ["QUERIES", "SQL", "with_states"]
