"""Benchmark decontamination by a positional inverted index.

Terms of the benchmark are counted over all documents; each window of an item (13
consecutive words, or a whole shorter item) is looked up by its two rarest terms.
The index holds the postings of those terms alone: document, position, and the words
around it. Posting lists, adjusted by the term's offset in the window, are intersected on
(document, start); the words around the posting confirm the phrase exactly. Where
both lists meet within a few words of each other without the phrase, that is a proximity match.

The benchmark's terms are dealt by hash into blocks of about ``BLOCK_TERMS`` (all rows
are scanned for each block), so the terms that a task is sent stay bounded however long the benchmark or an
item is. Postings of heavy terms are salted, and the lookups of those repeated for each salt.
Everything is DataFrame expressions.

Defined results: null texts have no words; an item without words matches nothing; a
null item_id's windows hit but aren't named; repeated items match each; null and repeated doc_ids are judged
row by row; very long texts are taken whole; empty tables give no rows or no hits; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm.common import HEAVY, forget, stored
from quorumlake.llm.fingerprints import folded

WINDOW = 13
#: Distinct terms of the benchmark in a block, on average: they are dealt by hash.
BLOCK_TERMS = 20_000
#: Most tasks over which a heavy term's postings are dealt.
SALTS = 1_024
#: Lists intersected for each window, and how far apart their starts may be in a proximity match.
RAREST, SLACK = 2, 4
#: Fixed value: what separates words, [\x00-\x2F\x3A-\x60\x7B-\x7F] of a text with A-Z lower-cased.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase): the distinct windows of each item."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.when(F.size("w") <= window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - window))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("phrase")).distinct()


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n): occurrences over all documents."""
    kept = F.filter(words_of(F.col("text")), lambda w: w.isin(terms))
    return docs.select(F.explode(kept).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(window_id, item_id, phrase, role, term, offset, n): the terms by which each window is looked up, with their counts."""
    keyed = windows.withColumn("window_id", F.xxhash64("item_id", "phrase"))
    terms = keyed.select("*", F.posexplode("phrase").alias("offset", "term")).join(counts, "term", "left").fillna(0, ["n"])
    by = Window.partitionBy("window_id", "item_id", "phrase").orderBy("n", "term", "offset")
    return terms.withColumn("role", F.row_number().over(by) - 1).where(F.col("role") < rarest).select("window_id", "item_id", "phrase", "role", "term", "offset", "n")


def postings(docs: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, n_words, hits): each document's postings of the terms with the words around them."""
    around = F.lit(window - 1)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), words_of(F.col("text")).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.when(w.isin(terms), i)), lambda i: i.isNotNull())
    hits = F.transform(places, lambda i: F.struct(F.get("w", i).alias("term"), i.alias("pos"), F.greatest(i - around, F.lit(0)).alias("first"), F.slice("w", F.greatest(i - around, F.lit(0)) + 1, 2 * window - 1).alias("context")))
    return rows.select("doc_id", "row_key", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))


def candidates(index: DataFrame, lookups: DataFrame, total: int) -> DataFrame:
    """Offset-adjusted postings: (doc_id, row_key, window_id, item_id, role, start, length, exact). total: occurrences of all terms looked up."""
    line = max(1, total // HEAVY)
    salts = F.least(F.ceil(F.col("n") / line), F.lit(SALTS)).cast("int")
    heavy = lookups.where(F.col("n") > line).select("term", salts.alias("salts")).distinct()  # at most HEAVY
    wanted = lookups.withColumn("salt", F.explode(F.when(F.col("n") > line, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))).drop("n")
    rows = index.select("doc_id", "row_key", F.explode("hits").alias("h")).select("doc_id", "row_key", "h.term", "h.pos", "h.first", "h.context")
    rows = rows.join(F.broadcast(heavy), "term", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_key", "pos"), "salts"), F.lit(0)).cast("int")).drop("salts")
    met = rows.join(wanted, ["term", "salt"]).withColumn("start", F.col("pos") - F.col("offset")).where(F.col("start") >= 0)
    exact = F.slice("context", F.col("start") - F.col("first") + 1, F.size("phrase")) == F.col("phrase")
    inside = F.col("start") >= F.col("first")
    return met.select("doc_id", "row_key", "window_id", "item_id", "role", "start", F.size("phrase").alias("length"), F.when(inside, exact).otherwise(False).alias("exact"))


def phrase_matches(found: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, start, length): starts on every list of a window, with the phrase confirmed."""
    lists = F.least(F.col("length"), F.lit(RAREST))
    met = found.where("exact").groupBy("doc_id", "row_key", "window_id", "item_id", "start", "length").agg(F.bit_or(F.expr("shiftleft(1, role)")).alias("roles"))
    return met.where(F.bit_count("roles") == lists).select("doc_id", "row_key", "item_id", "start", "length")


def proximity_matches(found: DataFrame, slack: int = SLACK) -> DataFrame:
    """(doc_id, row_key, item_id, start, gap): the two rarest terms with starts at most ``slack`` apart, without the phrase there.

    The second list is looked up in cells of ``slack`` starts, so that it is an equality join.
    """
    key = ["doc_id", "row_key", "window_id", "item_id"]
    cell = F.floor(F.col("start") / (slack + 1))
    a = found.where("role = 0 AND NOT exact").select(*key, "start", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = found.where("role = 1 AND NOT exact").select(*key, F.col("start").alias("other"), cell.alias("cell")).distinct()
    same = [a[k].eqNullSafe(b[k]) for k in [*key, "cell"]]
    near = F.abs(F.col("start") - F.col("other"))
    met = a.join(b, same).where(near <= slack)
    return met.groupBy(*[a[k] for k in key], "start").agg(F.min(near).alias("gap")).drop("window_id")


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_words) of every row of docs, and the candidates for the benchmark's windows from the stored index."""
    windows = stored(item_windows(benchmark, window), "windows")
    terms = stored(windows.select(F.explode("phrase").alias("term")).distinct(), "terms")
    blocks = max(1, -(-terms.count() // block_terms))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))

    def of(frame: DataFrame, k: int) -> list[str]:
        return [r[0] for r in frame.where(block == k).select("term").distinct().collect()]  # bounded by the block

    def together(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    counts = together([stored(term_counts(docs, of(terms, k)), "term_counts") for k in range(blocks)])
    lookups = stored(rarest_terms(windows, counts), "lookups")
    total = lookups.select("term", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    index = [stored(postings(docs, of(lookups, k), window), "postings") for k in range(blocks)]
    found = together([candidates(index[k], lookups.where(block == k), total) for k in range(blocks)])
    forget(windows, terms)
    return index[0].select("doc_id", "row_key", "n_words"), found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_terms: int = BLOCK_TERMS, near: bool = False) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items[, near]) of every row of docs; items are sorted as strings.

    ``row_key`` is xxhash64(doc_id, text); n_hit counts words inside any occurrence of a window; near has the proximity matches
    as (item_id, start, gap).
    """
    totals, found = searched(docs, benchmark, window, block_terms)
    found = stored(found, "candidates")
    judged = _judged(totals, phrase_matches(found))
    if not near:
        return judged
    some = proximity_matches(found).groupBy(F.col("doc_id").alias("near_id"), F.col("row_key").alias("near_key"))
    some = some.agg(F.array_sort(F.collect_set(F.struct(F.col("item_id").cast("string").alias("item_id"), "start", "gap"))).alias("near"))
    return judged.join(some, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("row_key") == F.col("near_key")), "left").select(*judged.columns, F.coalesce("near", F.array().cast(some.schema["near"].dataType)).alias("near"))


def _judged(totals: DataFrame, matches: DataFrame) -> DataFrame:
    """totals with the words that the matches cover and their items."""
    spans = matches.groupBy("doc_id", "row_key", "start").agg(F.max("length").alias("length"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    before = Window.partitionBy("doc_id", "row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))))
    hit = fresh.groupBy("doc_id", "row_key").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "n_hit", "items")
    rows = totals.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left")
    return rows.select("doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
