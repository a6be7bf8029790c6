"""The pipeline's stages against brute force, and the contract queries' columns."""

from __future__ import annotations

import random

import pytest
from test_operators import brute_hits, brute_lines, brute_links, corpus, words

import corpus_pipeline
from quorumlake.llm.common import stored
from quorumlake.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus in two languages."""
    rng = random.Random(12)
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in corpus()]
    rows += [(200 + i, " ".join(words(rng, 40)), "en", "s0", 0) for i in range(40)]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    items = [(1, " ".join(rows[0][1].split()[-40:])), (2, "one"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), items


def test_stages_follow_brute_force(spark, folder):
    where, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_copies", "decontamination", "packing"]

    def after(name, docs):
        out = stored(stages[name](spark, docs, where), name)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        return out, rows, [(r.doc_id, r.text) for r in out.collect()]

    docs, before, got = after("language_id", docs)
    assert sorted(map(repr, got)) == sorted(repr(r) for r in before if any(c.isalpha() for c in r[1] or ""))
    assert docs.columns == corpus_pipeline.COLUMNS
    docs, before, got = after("line_dedup", docs)
    assert sorted(map(repr, got)) == sorted(repr((d, t)) for d, _, _, t in brute_lines(before))
    docs, before, got = after("near_copies", docs)
    want = {(d, t) for (d, t), (_, first, _, _) in zip(before, brute_links(before), strict=True) if d == first}
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    docs, before, got = after("decontamination", docs)
    want = [(d, t) for (d, t), (_, n, hit, _) in zip(before, brute_hits(before, items), strict=True) if not (hit and 20 * hit >= n)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) < len(before)
    packed = stages["packing"](spark, docs, where).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in got}


def test_near_copies_of_null_and_repeated_ids(spark):
    """A group keeps exactly one row, whether its ids are null, repeat in other groups or belong to different texts."""
    rng = random.Random(5)
    base, other, null, lone = (words(rng, 80) for _ in range(4))
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [(1, " ".join(base)), (None, near(base, 20)), (2, near(base, 50))]
    rows += [(None, " ".join(lone)), (None, "one more text without an id")]
    rows += [(2, " ".join(other)), (7, near(other, 10))]
    rows += [(None, " ".join(null)), (None, near(null, 30)), (None, near(null, 60))]
    rows += [(9, "a b c d e f"), (9, "a  b c d e f"), (9, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    groups = [rows[:3], [rows[3]], [rows[4]], rows[5:7], rows[7:10], rows[10:]]
    assert [sum(r in g for r in got) for g in groups] == [1] * len(groups) and len(got) == len(groups)
    assert {rows[0], rows[3], rows[4], rows[5]} <= set(got)


def test_run_applies_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


COLUMNS = {
    "op1": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["kind", "doc_id", "page_id", "lang", "confidence", "accepted", "text_lang"],
    "op4": ["doc_id", "class_id", "class_size", "n_links"],
    "op5": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8": ["page_id", "host", "path", "rule", "verdict"],
    "op9": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_the_smallest_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    out = QUERIES[name](spark, sf).toPandas()
    assert list(out.columns) == COLUMNS[name.split("_")[0]]
    if name in SQL:
        db = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.execute(SQL[name]).fetchdf()[list(out.columns)]
        assert sorted(map(repr, out.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))
