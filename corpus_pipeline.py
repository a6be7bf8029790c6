"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read as the next stage's documents. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.

Defined results, for every stage: rows are told apart by doc_id and the text's hash, so null and repeated ids
harm no other row; a null text is an empty one (language ID rejects it, as it does every text without letters); very long
texts are taken whole; of copies and ties the row with the least (doc_id, text hash) stays;
an empty table gives an empty one; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import stored, table
from quorumlake.llm.decontamination import decontaminate
from quorumlake.llm.jaccard_join import near_duplicates, one_of_each
from quorumlake.llm.language_id import identify
from quorumlake.llm.line_dedup import line_dedup
from quorumlake.llm.packing import pack_documents
from quorumlake.llm.queries import contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language no evidence supports go."""
    gone = identify(docs).where(~F.col("accepted")).select(F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash")).distinct()
    gone = stored(gone, "rejected")
    return docs.join(gone, at(gone), "left_anti").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents stay in one of them."""
    kept = line_dedup(docs, passed=["lang", "source"])
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def at(marks: DataFrame) -> Column:
    """Whether a row of docs is the one that marks (at_id, at_hash) name."""
    return F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.xxhash64("text") == F.col("at_hash"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least (doc_id, text hash), a null id last, and once if its row repeats."""
    judged = stored(one_of_each(stored(near_duplicates(docs), "classes")), "judged")
    rows = judged.groupBy(F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash")).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = stored(rows.where(~F.col("stays") | (F.col("n") > 1)), "copies_gone")
    repeated = docs.join(marks.where("stays"), at(marks), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(marks, at(marks), "left_anti").select(COLUMNS).unionByName(repeated.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which hold too much of a benchmark go."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(judged.where(contaminated()).select(F.col("row_key").alias("gone_key")).distinct(), "contaminated")
    return docs.join(gone, F.xxhash64("doc_id", "text") == F.col("gone_key"), "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    out = pack_documents(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language ID, near copies and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
