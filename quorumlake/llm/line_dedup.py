"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

State (:class:`LineIndex`) is three tables:

* ``postings``  (key_hi, key_lo, doc_id): which documents hold a line key;
* ``counts``    (key_hi, key_lo, n_docs, max_doc): exact reference counts of every key;
* ``filters``   (shard, filter): a cuckoo filter per shard over the keys whose
  count reaches ``min_docs``.

Documents can be inserted and deleted. Both work on deltas: the counts of the lines that the documents
hold change, keys that reach ``min_docs`` are inserted into their shards' filters, and keys that fall
under it are deleted from them, so that their lines come back: the step is reversible. Other shards' filters stay.

When lines are judged, each goes to its shard, where a task holds one filter at a time; it answers
"certainly not repeated" for most lines. Each hit is confirmed against the exact counts, so false positives
never show. That is the same at every size.

Keys are 128-bit hashes of normalised lines. Hot keys: at most ``HEAVY`` keys can
hold more than 1/``HEAVY`` of the postings, so those are broadcast (a proven
bound) and never meet in one task; the others are dealt by shard and joined by key.

Defined results: a null text is an empty text (one empty line); a null doc_id is
a document whose id is below all others; rows that repeat a doc_id are one
document for counting, and each row is returned; very long texts are taken whole; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import BLANKS, HEAVY, forget, shared_dir, slices, slots, stored

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys for each filter shard.
SHARD_KEYS = 50_000
#: Tasks over which the lines of heavy keys are dealt.
SALTS = 1_024
SLOTS = 4  # fingerprints in a bucket


def line_key(line: str) -> str:
    """The line without blanks at its ends, A-Z in lower case (other letters stay)."""
    line = line.strip(BLANKS)
    return line.lower() if line.isascii() else line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def key_hash(key: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


class CuckooFilter:
    """A cuckoo filter with 16-bit fingerprints, four to a bucket, over 64-bit hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (h & np.uint64(self.mask)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        spread = (print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.mask)
        return bucket ^ spread.astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(hashes)
        same = print_[:, None]
        return (self.table[first] == same).any(1) | (self.table[second] == same).any(1)

    def insert(self, hashes: np.ndarray) -> CuckooFilter:
        """Returns the filter that holds the hashes: itself, or a larger one if this one filled up."""
        print_, first, second = self._places(hashes)
        for f, a, b in zip(print_, first, second, strict=True):
            if not self._put(f, int(a), int(b)):
                raise OverflowError("filter is full")
        return self

    def _put(self, f: np.uint16, a: int, b: int) -> bool:
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = f
                return True
        bucket = b
        for kick in range(500):
            slot = kick % SLOTS
            f, self.table[bucket, slot] = self.table[bucket, slot], f
            bucket = int(self._other(np.array([bucket]), np.array([f], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = f
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out hashes that were inserted before."""
        print_, first, second = self._places(hashes)
        for f, a, b in zip(print_, first, second, strict=True):
            for bucket in (int(a), int(b)):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def build_filter(hashes: np.ndarray) -> CuckooFilter:
    """A filter over distinct hashes; doubles until all fit."""
    size = max(1, len(hashes))
    while True:
        try:
            return CuckooFilter.for_keys(size).insert(hashes)
        except OverflowError:
            size *= 2


def _row_keys(text: str | None, min_chars: int) -> Iterator[tuple[str, tuple[int, int] | None]]:
    for line in (text or "").split("\n"):
        key = line_key(line)
        yield line, key_hash(key) if len(key) >= min_chars else None


def _postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key_hi, key_lo, doc_id), once for each row of docs and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hi, lo = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {k for _, k in _row_keys(text, min_chars) if k}
                ids += [doc] * len(keys)
                hi += [k[0] for k in keys]
                lo += [k[1] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(ids, pa.int64())], ["key_hi", "key_lo", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key_hi long, key_lo long, doc_id long")


_KEY = ["key_hi", "key_lo"]


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _same(a: DataFrame, b: DataFrame) -> list:
    return [a[k].eqNullSafe(b[k]) for k in (*_KEY, "doc_id")]


class LineIndex:
    """Exact line reference counts with sharded cuckoo filters; see the module's docstring."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame | None, shards: int | None, min_chars: int, min_docs: int):
        """counts and filters are stored tables; without filters they are built from the counts."""
        self.postings, self.counts, self.min_chars, self.min_docs = postings, counts, min_chars, min_docs
        often = counts.where(F.col("n_docs") >= min_docs)
        self.total = often.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("held")).first()
        self.shards = shards or max(1, -(-self.total.keys // SHARD_KEYS))
        self.filters = stored(self._built(often), "line_filters") if filters is None else filters

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        postings = _postings_of(docs, min_chars).distinct()
        return cls(postings, stored(_counted(postings), "line_counts"), None, None, min_chars, min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents added."""
        seen = _postings_of(docs, self.min_chars).distinct()
        fresh = stored(seen.join(self.postings, _same(seen, self.postings), "left_anti"), "line_delta")
        delta = _counted(fresh).select(*_KEY, F.col("n_docs").alias("more"), F.col("max_doc").alias("new_max"))
        changes = self.counts.join(delta, _KEY, "full")
        n, was = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0)), F.coalesce("n_docs", F.lit(0))
        after = stored(changes.select(*_KEY, n.alias("n_docs"), F.greatest("max_doc", "new_max").alias("max_doc"), was.alias("was")), "line_counts")
        return self._changed(stored(self.postings.unionByName(fresh), "line_postings"), after)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose doc_id is in ids."""
        gone_ids = ids.select(F.col("doc_id").alias("gone_id")).distinct()
        out = F.col("doc_id").eqNullSafe(F.col("gone_id"))
        gone = _counted(self.postings.join(gone_ids, out, "left_semi")).select(*_KEY, F.col("n_docs").alias("less"))
        left = stored(self.postings.join(gone_ids, out, "left_anti"), "line_postings")
        touched = stored(self.counts.join(gone, _KEY).select(*_KEY, (F.col("n_docs") - F.col("less")).alias("n_docs"), F.col("n_docs").alias("was")), "line_delta")
        tops = left.join(touched.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.max("doc_id").alias("max_doc"))
        lowered = touched.join(tops, _KEY, "left").select(*_KEY, "n_docs", "max_doc", "was")
        same = self.counts.join(touched.select(*_KEY), _KEY, "left_anti").select(*_KEY, "n_docs", "max_doc", F.col("n_docs").alias("was"))
        return self._changed(left, stored(same.unionByName(lowered).where("n_docs > 0 OR was > 0"), "line_counts"))

    def _changed(self, postings: DataFrame, after: DataFrame) -> LineIndex:
        """The index with new counts (and each key's count as it was): only the filters of shards whose keys cross ``min_docs`` change."""
        now, was = F.col("n_docs") >= self.min_docs, F.col("was") >= self.min_docs
        crossed = after.where(now != was).select(self._shard(), "key_lo", now.alias("add"))

        def run(held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            shard = int((held if len(held) else changes)["shard"].iloc[0])
            if not len(changes):
                return held[["shard", "filter"]]
            made = CuckooFilter.load(bytes(held["filter"].iloc[0])) if len(held) else CuckooFilter.for_keys(SHARD_KEYS)
            made.delete(changes.loc[~changes["add"], "key_lo"].to_numpy(np.int64))
            try:
                made.insert(changes.loc[changes["add"], "key_lo"].to_numpy(np.int64))
            except OverflowError:
                return pd.DataFrame({"shard": [shard], "filter": [None]})  # built anew from the counts
            return pd.DataFrame({"shard": [shard], "filter": [made.dump()]})

        new = stored(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(run, "shard long, filter binary"), "line_filters")
        full = new.where("filter IS NULL").select("shard")
        often = after.where(F.col("n_docs") >= self.min_docs).withColumn("shard", self._shard()).join(full, "shard", "left_semi")
        filters = stored(new.where("filter IS NOT NULL").unionByName(self._built(often)), "line_filters")
        counts = stored(after.where("n_docs > 0").drop("was"), "line_counts")
        return LineIndex(postings, counts, filters, self.shards, self.min_chars, self.min_docs)

    def _shard(self) -> Column:
        return F.pmod("key_hi", F.lit(self.shards)).alias("shard")

    def _built(self, often: DataFrame) -> DataFrame:
        """(shard, filter) over the keys of these counts."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            made = build_filter(pdf["key_lo"].to_numpy())
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [made.dump()]})

        return often.select(self._shard(), "key_lo").groupBy("shard").applyInPandas(run, "shard long, filter binary")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys that each document loses, 16 bytes each."""
        counts = self.counts.where(F.col("n_docs") >= self.min_docs)
        line = max(1, self.total.held // HEAVY)
        heavy = counts.where(F.col("n_docs") > line).select(*_KEY, F.lit(True).alias("heavy"), F.col("max_doc").alias("heavy_max"))
        probes = _postings_of(docs, self.min_chars).join(F.broadcast(heavy), _KEY, "left")
        salt = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))  # heavy lines have met their count and pass any task
        probes = probes.select(F.when(F.col("heavy"), salt).otherwise(self._shard()).cast("long").alias("shard"), *_KEY, "doc_id", "heavy", "heavy_max", F.lit(None).cast("binary").alias("filter"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("key_hi", "long"), ("key_lo", "long"), ("doc_id", "long"), ("heavy", "boolean"), ("heavy_max", "long"))]
        both = probes.unionByName(self.filters.select("shard", *none, "filter"))
        dealt = both.repartition(slots(docs.sparkSession), "shard").sortWithinPartitions("shard", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                low = batch.column("key_lo").fill_null(0).to_numpy()
                keep = shard < 0
                for begin, end in zip(edges := [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist()], [*edges[1:], len(shard)], strict=True):
                    if begin == end or shard[begin] < 0:
                        continue
                    if shard[begin] != at:
                        at, held = shard[begin], None
                    if (blob := batch.column("filter")[begin].as_py()) is not None:  # a shard's filter is its first row
                        held, begin = CuckooFilter.load(blob), begin + 1
                    if held is not None and begin < end:
                        keep[begin:end] = held.contains(low[begin:end])
                yield batch.filter(pa.array(keep)).select([*_KEY, "doc_id", "heavy", "heavy_max"])

        found = stored(dealt.mapInArrow(run, "key_hi long, key_lo long, doc_id long, heavy boolean, heavy_max long"), "line_hits")
        light = found.where("heavy IS NULL").join(counts.where(F.col("n_docs") <= line).hint("merge"), _KEY)
        loses = light.where(~F.col("doc_id").eqNullSafe(F.col("max_doc"))).select(*_KEY, "doc_id")
        loses = loses.unionByName(found.where(F.col("heavy") & ~F.col("doc_id").eqNullSafe(F.col("heavy_max"))).select(*_KEY, "doc_id"))
        out = stored(loses.groupBy("doc_id").agg(F.collect_set(F.struct("key_hi", "key_lo")).alias("keys")), "line_drops")
        forget(found)
        return out

    def apply(self, docs: DataFrame, passed: list[str] = ()) -> DataFrame:
        """Each row of docs with its text without dropped lines: doc_id, text, n_lines, n_dropped, and the columns passed."""
        min_chars = self.min_chars
        drops = self.dropped(docs).select(F.col("doc_id").alias("drop_id"), F.transform("keys", lambda k: F.struct(k.key_hi.alias("h"), k.key_lo.alias("l"))).alias("drop_keys"))
        rows = docs.select("doc_id", "text", *[F.col(c) for c in passed]).join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").drop("drop_id")
        names = ["doc_id", "text", *passed]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts, total, gone = [], [], []
                for text, keys in zip(batch.column("text").to_pylist(), batch.column("drop_keys").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    if keys:
                        out = {(k["h"], k["l"]) for k in keys}
                        kept = [line for line, k in _row_keys(text, min_chars) if k not in out]
                    else:
                        kept = lines
                    texts.append("\n".join(kept))
                    total.append(len(lines))
                    gone.append(len(lines) - len(kept))
                cols = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
        schema = ", ".join([*(f"`{n}` {fields[n]}" for n in names), "n_lines long", "n_dropped long"])
        return rows.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, passed: list[str] = ()) -> DataFrame:
    """Builds the index over docs and applies it to them."""
    shared_dir(docs.sparkSession)
    return LineIndex.build(docs, min_chars, min_docs).apply(docs, passed)
