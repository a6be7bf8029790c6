"""The contract queries opN_<name> over the shared tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quorumlake.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.line_dedup import line_dedup

    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Fixed values in SQL: the characters [\x20\x09-\x0D].
_SQL_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op6_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, {_SQL_LOWER.format(f"trim(line, {_SQL_BLANKS})")} AS k FROM lines),
held AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, held.k IS NOT NULL AND doc_id <> held.last AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def _spans(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _kind_is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.secrets import secret_scan

    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    counts = [F.size(F.filter("spans", _kind_is(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    found = found.withColumn("base", base)
    return found.select("doc_id", *counts, F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


#: Scores from which a document counts as toxic.
TOXIC_AT = 0.7


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.toxicity import held_out, toxicity, train

    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and pages (page_id), told apart by kind."""
    from quorumlake.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")).drop("text_hash")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.fingerprints import fingerprint_edits, shown

    rows = fingerprint_edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.decontamination import decontaminate

    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_SQL_WORDS = f"list_filter(regexp_split_to_array({_SQL_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

SQL["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.p = iw.p),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    from quorumlake.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("comp", "text_hash")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.substring_dedup import substring_dedup

    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["op5_substring_dedup"] = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM r),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT words.*, gone.pos IS NOT NULL AS out FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos),
agg AS (SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT out) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id"""
