"""Readers of text, databases, archives and study folders, inference, the gate, and the engine's front end."""

from __future__ import annotations

import sqlite3
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake import testdata
from quorumlake.engine import Engine
from quorumlake.functions import survival
from quorumlake.model import Refusal
from quorumlake.operators import gate, infer
from quorumlake.queries import FLAGSHIP, doc, exists, value
from quorumlake.sources import database, delimited, files, parquet, study

SF = "/root/testdata/sf0.001"


def test_sniffing():
    assert delimited.detect(b"a;b;c\n1;2;3\n") == delimited.Format("utf-8", ";", 0)
    assert delimited.detect("﻿a\tb\né\t2\n".encode("utf-8")).encoding == "utf-8-sig"
    assert delimited.detect("a,b\né,2\n".encode("cp1252")).encoding == "cp1252"
    assert delimited.detect(b"# export\na,b\n1,2\n3,4\n").skip == 1


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('# note\na,b\n1,"x, y"\n2,z\n')
    (tmp_path / "u.tsv").write_text("a\tb\n1\tq\n")
    tables = files.read_folder(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in tables["t"].collect()] == [("1", "x, y"), ("2", "z")] and tables["u"].columns == ["a", "b"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.csv", "a,b\n1,2\n")
    assert files.read_archive(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))["t"].count() == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../t.csv", "a")
    with pytest.raises(Refusal):
        files.read_archive(spark, str(tmp_path / "b.zip"), str(tmp_path / "out2"))


def test_databases(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "d.sqlite")
    db.executescript("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE c (p INTEGER REFERENCES p(id), v REAL); INSERT INTO p VALUES (1, 'a'); INSERT INTO c VALUES (1, 2.5), (NULL, NULL);")
    db.close()
    got = database.read_sqlite(spark, str(tmp_path / "d.sqlite"))
    assert got.keys == {"p": ("id",)} and got.references == [("c", ("p",), "p", ("id",))] and got.tables["c"].count() == 2
    import duckdb

    duck = duckdb.connect(str(tmp_path / "d.duckdb"))
    duck.execute("CREATE TABLE t (k BIGINT PRIMARY KEY, s VARCHAR)")
    duck.execute("INSERT INTO t VALUES (1, 'x')")
    duck.close()
    snap = database.read_duckdb(spark, str(tmp_path / "d.duckdb"))
    assert snap.keys == {"t": ("k",)} and snap.tables["t"].count() == 1


def test_parquet_types(spark, tmp_path):
    spark.range(2).select(F.col("id").cast("int").alias("i"), F.lit(1.5).cast("decimal(5,2)").alias("d")).write.parquet(f"{tmp_path}/t")
    assert parquet.read_parquet(spark, f"{tmp_path}/t").dtypes == [("i", "bigint"), ("d", "string")]
    spark.range(1).select(F.struct("id").alias("s")).write.parquet(f"{tmp_path}/n")
    with pytest.raises(Refusal):
        parquet.read_parquet(spark, f"{tmp_path}/n")
    parquet.write_table(spark.range(3).toDF("a"), f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w").count() == 3


def test_study_folder(spark, tmp_path):
    (tmp_path / "data_clinical_patient.txt").write_text("#Id\tAge\n#Id\tAge\n#STRING\tNUMBER\n#1\t1\nPATIENT_ID\tAGE\np1\t50\np2\tNA\n")
    (tmp_path / "data_cna.txt").write_text("Hugo_Symbol\ts1\ts2\nTP53\t-2\tNA\nMYC\t2\t0\n")
    (tmp_path / "cases.txt").write_text("stable_id: all\ncase_list_ids: s1\ts2\n")
    made = study.read_study(spark, f"file://{tmp_path}")
    assert [(r["AGE"], r["AGE__state"]) for r in made["patients"].orderBy("PATIENT_ID").collect()] == [(50.0, "PRESENT"), (None, "UNKNOWN")]
    assert sorted(tuple(r) for r in made["cna_calls"].collect()) == [("MYC", "s1", "amplification"), ("MYC", "s2", "diploid"), ("TP53", "s1", "deep_deletion")]
    assert study.case_list(spark, f"file://{tmp_path}/cases.txt").count() == 2


def test_inference(spark):
    rows = [(str(i), f"{i}.5", "x" if i % 2 else "y", "a;b", f"id{i}", "NA" if i == 3 else "2020-01-01") for i in range(40)]
    frame = spark.createDataFrame(rows, "i string, n string, c string, l string, s string, d string")
    assert {r["column"]: r["datatype"] for r in infer.datatypes(frame).collect()} == {"i": "integer", "n": "number", "c": "category", "l": "list<category>", "s": "string", "d": "date"}
    orders, customers = (testdata.read(spark, SF, t) for t in ("orders", "customer"))
    found = infer.references({"orders": orders.select("o_orderkey", "o_custkey"), "customer": customers.select("c_custkey")}, {"customer": "c_custkey"})
    assert found == [("orders", "o_custkey", "customer", "c_custkey")]


def test_gate_finds_what_is_wrong(spark):
    made = testdata.release(spark, SF)
    assert gate.gate(made).collect() == []
    made.tables["customer"].frame = made.tables["customer"].frame.where("c_custkey > 5")
    assert {r["check"] for r in gate.gate(made).collect()} == {"DANGLING_REFERENCE"}


def test_runs_of_documents(spark):
    views = [
        {"analysis": "compare.existence", "cohorts": ["a", "b"], "reference": "b", "params": {"predicates": [exists("orders", min_count=8)]}},
        {"analysis": "summary.distribution", "params": {"variables": [{"column": "customer.c_acctbal"}, {"column": "customer.c_mktsegment"}]}},
        {"analysis": "compare.columns", "params": {"variables": [{"column": "customer.c_acctbal"}, {"column": "customer.c_mktsegment"}]}},
        {"analysis": "summary.members", "cohorts": ["a"], "params": {"limit": 3}},
    ]
    d = doc("customer", views, a=FLAGSHIP, b={"not": {"kind": "cohort", "cohort": "a"}})
    made = Engine(testdata.release(spark, SF))
    first, second = made.run(d), made.run(d)
    assert first["cohorts"]["a"]["n_true"] == 34 and len(first["views"]) == 4 and len(first["views"][3]["values"]["keys"]) == 3
    assert [v["digest"] for v in first["views"]] == [v["digest"] for v in second["views"]]
    said = made.explain(d)["a"]
    assert said["id"].startswith("drv:") and "BUILDING" in said["says"]
    swapped = doc("customer", a={"all": FLAGSHIP["all"][::-1]})
    assert made.explain(swapped)["a"]["id"] == said["id"]
    assert Engine(made.release, least=50).count_cohort(d, "a")["n_true"] is None


def test_survival_views(spark):
    made = Engine(testdata.follow_up(spark, SF))
    d = doc("customer", a=value("customer.c_acctbal", range={"lt": 4000}), b=value("customer.c_acctbal", range={"gte": 4000}))
    km = made.run(d | {"views": [{"analysis": "survival.km", "params": {"endpoint": "ep:last_order", "landmarks": [1000]}}]})["views"][0]["values"]
    assert set(km["curves"]) == {"a", "b"} and 0 <= km["log_rank"]["p"] <= 1
    cox = made.run(d | {"views": [{"analysis": "survival.cox", "cohorts": ["a"], "params": {"endpoint": "ep:last_order", "variables": [{"column": "customer.c_acctbal"}]}}]})["views"][0]["values"]
    assert cox["n"] > 0 and len(cox["ph_p"]) == 1


def test_cox_view_of_delayed_entry_and_strata(spark):
    """The view fits the risk sets that its endpoint and strata define; rows with entry at or after time go."""
    release = testdata.follow_up(spark, SF)
    ep = release.endpoints["ep:last_order"]
    table = release.tables["customer"].frame
    rows = [r for r in table.collect() if r[ep.status] in (*ep.events, *ep.censored) and r[ep.time] is not None and r[ep.time] >= 0]
    middle = sorted(r[ep.time] for r in rows)[len(rows) // 4]
    table = table.withColumn("late", F.when(F.col("c_custkey") % 2 == 0, F.lit(float(middle))).otherwise(F.lit(-1.0)))
    release.tables["customer"].frame = table
    release.endpoints["ep:late"] = replace(ep, id="ep:late", entry="late")
    d = doc("customer", a={"all": []})
    params = {"endpoint": "ep:late", "variables": [{"column": "customer.c_acctbal"}], "strata": [{"column": "customer.c_mktsegment"}]}
    got = Engine(release).run(d | {"views": [{"analysis": "survival.cox", "cohorts": ["a"], "params": params}]})["views"][0]["values"]
    entry = [float(middle) if r.c_custkey % 2 == 0 else -1.0 for r in rows]
    kept = [(float(r[ep.time]), int(r[ep.status] in ep.events), float(r.c_acctbal), e, r.c_mktsegment) for r, e in zip(rows, entry, strict=True) if e < r[ep.time]]
    time, event, x, entry = (np.array([k[i] for k in kept]) for i in range(4))
    strata = np.unique([k[4] for k in kept], return_inverse=True)[1]
    want = survival.cox(time, event, x[:, None], entry, strata)
    assert len(kept) < len(rows) and got["n"] == len(kept)
    assert got["beta"] == pytest.approx(want["beta"], rel=1e-6) and got["se"] == pytest.approx(want["se"], rel=1e-6)
    assert got["ph_p"] == pytest.approx(survival.proportional_hazards(time, event, x[:, None], want, entry, strata), rel=1e-6)


def test_cox_view_of_more_than_a_million_cells(spark):
    release = testdata.follow_up(spark, SF)
    ep, k, n = release.endpoints["ep:last_order"], F.col("id"), 350_000
    columns = {"c_custkey": k, ep.time: (k * 7919 % 5 + 1).cast("double"), ep.status: F.when(k * 31 % 11 < 7, ep.events[0]).otherwise(ep.censored[0]), "c_acctbal": (k * 17 % 13).cast("double")}
    table = release.tables["customer"]
    table.frame = spark.range(n).select(*[columns.get(c, F.lit(None).cast(t)).alias(c) for c, t in table.frame.dtypes])
    params = {"endpoint": "ep:last_order", "variables": [{"column": "customer.c_acctbal"}]}
    got = Engine(release).run(doc("customer", a={"all": []}) | {"views": [{"analysis": "survival.cox", "cohorts": ["a"], "params": params}]})["views"][0]["values"]
    i = np.arange(n)
    want = survival.cox(i * 7919 % 5 + 1.0, (i * 31 % 11 < 7).astype(int), (i * 17 % 13)[:, None].astype(float))
    assert got["n"] == n and got["beta"] == pytest.approx(want["beta"], rel=1e-6) and got["se"] == pytest.approx(want["se"], rel=1e-6)


def test_pack_analysis(spark):
    made = Engine(testdata.release(spark, SF), analyses={"shop.total": lambda e, d, v: {"n": e.units(d, "a").count()}})
    out = made.run(doc("customer", [{"analysis": "shop.total"}], a={"all": []}))
    assert out["views"][0]["values"] == {"n": 150}
    with pytest.raises(Refusal):
        made.run(doc("customer", [{"analysis": "none"}], a={"all": []}))


def test_quoted_newlines_after_a_preamble(spark, tmp_path):
    from quorumlake.sources.delimited import read_delimited

    (tmp_path / "t.csv").write_text('# note\n\n# more\na,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", "x\ny"), ("2", "z")]


def test_means_of_tiny_and_huge_values(spark):
    from quorumlake.model import Coverage, Relationship, Release, table_from
    from quorumlake.operators.compile import Frame
    from quorumlake.operators.variables import variable
    from quorumlake.plans.resolve import Resolver

    values = {1: [1e-14, 3e-14], 2: [1e27, 3e27], 3: [0.1, 0.2, 0.3], 4: [1e18, 1.0], 5: [-5e-324, 5e-324]}
    rel = Relationship("parts", ("whole",), "wholes", ("whole",))
    tables = {"wholes": table_from("wholes", spark.createDataFrame([(k,) for k in values], "whole long"), ("whole",)), "parts": table_from("parts", spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "whole long, size double"))}
    made = Release("r", tables, (rel,), {rel.id: Coverage("all")})
    frame = Frame(made, "wholes")
    v = variable(frame, {"aggregate": "mean", "column": "parts.size"}, Resolver(made, "wholes"))
    got = {r.whole: float(r.val) for r in frame.df.select("whole", v.val.alias("val")).collect()}
    assert got == pytest.approx({1: 2e-14, 2: 2e27, 3: 0.2, 4: 5e17, 5: 0.0}, rel=1e-15)


def test_nothing_leaks_under_a_least_count(spark):
    """Analyses refuse or hold back what a hidden count would follow from."""
    from quorumlake import testdata
    from quorumlake.engine import Engine
    from quorumlake.model import Refusal

    engine = Engine(testdata.release(spark, "/root/testdata/sf0.001"), least=1000)
    document = {"dataset": "tpch", "unit": "customer", "cohorts": {"a": {"all": []}}, "views": [
        {"id": "v", "analysis": "summary.distribution", "params": {"variables": [{"column": "customer.c_mktsegment"}, {"column": "customer.c_acctbal"}]}}]}
    from quorumlake.plans.document import parse

    doc = parse(document)
    assert engine.summary_distribution(doc, doc.views[0])["variables"] == [{"a": {"suppressed": True}}] * 2
    with pytest.raises(Refusal):
        engine._endpoint({"params": {"endpoint": "ep"}})
