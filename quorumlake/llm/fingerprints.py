"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the sorted array of the ``K`` smallest distinct 40-bit hashes of a text's
five-word shingles. Sketches merge by union, and estimate resemblance, containment and
the number of distinct shingles. Everything is a DataFrame expression.

Words are runs of characters other than blanks, A-Z in lower case; a text of one to
four words is one shingle, and a text of none has an empty sketch.

Defined results: a null text is empty; two empty sketches resemble each other fully,
an empty and another one not at all; in the order of documents null ids come first and
ties are ordered by the text's hash; repeated rows are documents each, one after the other; a single document follows itself; very
long texts are taken whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm.common import ascii_lower

K = 128
SHINGLE = 5
BITS = 40
#: Documents in a bucket of neighbours, value ranges of about equal counts, and the most buckets in each: what the driver sees
#: is bounded by 200,000 rows, and a bucket holds some 130,000 documents of 25 thousand million.
BUCKET, RANGES, PARTS = 512, 64, 3_000


def folded(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """rows with the bottom-k sketch of a text column."""
    words, hashes = f"_{name}_words", f"_{name}_hashes"
    rows = rows.withColumn(words, F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), ""))
    rows = rows.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    step = ", ".join(f"{hashes}[i + {j}]" for j in range(size))
    shingles = F.expr(
        f"CASE WHEN size({hashes}) >= {size} THEN transform(sequence(0, size({hashes}) - {size}), i -> shiftrightunsigned(xxhash64({step}), {64 - BITS})) "
        f"WHEN size({hashes}) > 0 THEN array(shiftrightunsigned(xxhash64(array_join({words}, ' ')), {64 - BITS})) ELSE CAST(array() AS array<bigint>) END"
    )
    return rows.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(words, hashes)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(shared / F.nullif(F.size(both), F.lit(0)), F.lit(0.0))).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for a sketch that isn't full."""
    last = F.element_at(a, k)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((last + 1) / F.lit(float(1 << BITS))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    n_a, n_b, j = distinct_shingles(a, k), distinct_shingles(b, k), resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (n_a + n_b) / (1 + j) / n_a))


def shown(a: Column) -> Column:
    """A sketch as text: ten hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def merge_parts(parts: DataFrame, key: str, sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """The sketch of each key from those of its parts: distinct hashes, the k smallest."""
    hashes = parts.select(key, F.explode(sketch).alias("h")).distinct()
    best = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return best.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, at, copy, next_text): each document beside the next one by doc_id, the last beside the first.

    Documents are dealt into buckets of neighbouring ids (value ranges of about equal counts, cut
    evenly), and the first of each bucket goes to the bucket before as a copy, so that one
    shuffle of the texts finds every neighbour. The driver sees a row for each bucket, at most
    (RANGES + 2) * PARTS. Rows with ``copy`` set are to be dropped once no more needed.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts")).first()
    parts = max(1, min(PARTS, -(-ids.n // (RANGES * BUCKET))))
    # Null ids come first, in order of their texts' hashes: ranges of those are their buckets.
    none = F.floor(F.col("hash") / F.lit(float(1 << 63)) * parts).cast("long") - parts - 1
    if ids.low is None:
        bucket = none
    else:
        lows = sorted({ids.low, *(ids.cuts or [])})
        ends = [*lows[1:], ids.high + 1]
        cuts, widths = F.array(*map(F.lit, lows)), F.array(*[F.lit(b - a) for a, b in zip(lows, ends, strict=True)])
        at = F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
        fine = F.floor((F.col("doc_id") - F.element_at(cuts, at)) / F.element_at(widths, at) * parts)
        bucket = F.when(F.col("doc_id").isNull(), none).otherwise((at - 1) * parts + F.least(fine, F.lit(parts - 1))).cast("long")
    rows = rows.withColumn("bucket", bucket)
    heads = sorted((r["bucket"], r["h"]["doc_id"], r["h"]["hash"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash")).alias("h")).collect())
    before = [(h[1], h[2], heads[i - 1][0]) for i, h in enumerate(heads)]
    marks = docs.sparkSession.createDataFrame(before, "head_id long, head_hash long, before long")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
    marked = rows.join(F.broadcast(marks), is_head, "left").drop("head_id", "head_hash")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))))
    dealt = marked.withColumn("place", F.explode(places)).select("doc_id", "text", "hash", "place.bucket", "place.copy")
    return dealt.withColumn("next_text", F.lead("text").over(neighbours()))


def neighbours() -> Window:
    return Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "hash")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document with its sketch, its edited text and that one's sketch, and both resemblances."""
    rows = with_next(docs)
    cut = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))).drop("next_text")
    rows = with_sketch(rows, "text", "fingerprint", k)
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(neighbours())).where(~F.col("copy"))
    rows = with_sketch(rows, "edited_text", "edited_fingerprint", k)
    return rows.select("doc_id", "text", "edited_text", "fingerprint", "edited_fingerprint", resemblance(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"), resemblance(F.col("fingerprint"), F.col("next_fingerprint"), k).alias("near_next"))
