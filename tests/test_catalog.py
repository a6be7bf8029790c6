from __future__ import annotations

from dataclasses import replace

from quorumlake import charts, curation, testdata
from quorumlake.catalog import Catalog, Entry, applicable
from quorumlake.engine import Engine
from quorumlake.model import ColumnDef
from quorumlake.plans.document import parse
from quorumlake.queries import FLAGSHIP, doc, exists, value

SF = "/root/testdata/sf0.001"


def test_search_and_descriptions(spark):
    made = Catalog([Entry(testdata.release(spark, SF), "Shop and its texts", ("demo",), {"kind": "shop"}, {"orders": 1500})])
    assert made.search("orders shop", ["demo"], {"kind": "shop"}, 100) == ["tpch"] and made.search("trees") == [] and made.search(min_rows=10**6) == []
    assert made.describe_dataset("tpch")["relationships"]["rel:events.user_id"]["coverage"] == "undeclared"
    assert made.describe_column("tpch", "orders.o_orderpriority")["statistics"]["distinct"] == 5
    assert made.propose("tpch", "customer.c_custkey").datatype == "integer" and made.curation_queue("tpch") == []
    assert made.validate("tpch", doc("customer", a=FLAGSHIP)) is None
    assert made.validate("tpch", doc("customer", a=value("customer.none", values=[1]))) == "UNKNOWN_COLUMN"
    assert made.validate("tpch", doc("customer", [{"analysis": "survival.cox", "cohorts": ["a", "b"]}], a=FLAGSHIP, b=FLAGSHIP)) == "COHORT_ARITY"
    assert not applicable(testdata.release(spark, SF), "customer")["survival.km"] and applicable(testdata.follow_up(spark, SF), "customer")["survival.km"]


def test_curation_is_carried():
    base, mine = ColumnDef("a", "string"), ColumnDef("a", "category", permissible=("x",))
    out, conflicts = curation.carry_forward({"a": base}, {"a": mine}, {"a": ColumnDef("a", "integer", units="1"), "b": base})
    assert out["a"] == replace(mine, units="1") and out["b"].proposed and conflicts == ["a.datatype"]
    assert [e.id for e in curation.proposed_endpoints(["OS_MONTHS", "OS_STATUS", "PFS_MONTHS"])] == ["ep:os"]


def test_charts(spark):
    made = Engine(testdata.release(spark, SF))
    view = {"analysis": "compare.existence", "params": {"predicates": [exists("orders", min_count=8)]}}
    d = parse(doc("customer", [view], a=value("customer.c_acctbal", range={"lt": 3000}), b=value("customer.c_acctbal", range={"gte": 3000})))
    assert len(charts.existence(made.compare_existence(d, view))["data"]["values"]) == 2
    got = made.summary_distribution(d, {"params": {"variables": [{"column": "customer.c_acctbal"}]}})
    assert len(charts.distribution(got)["data"]["values"]) == 20
