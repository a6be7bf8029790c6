"""Substring dedup: a compressed FM-index for each shard, searched by backward search over wavelet matrices.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window whose
word sequence starts earlier somewhere (a smaller doc_id, or the same document
further left) covers it.

1. Each window has an anchor, the least hash among its ``GRAM``-word grams; neighbouring
   windows share one and form a segment. Equal windows have equal anchors, so a shard
   that gets all segments of an anchor sees every occurrence. One shuffle by anchor drops the
   segments whose anchor is met once in the corpus: their windows can't repeat. Anchors that may hold over
   1/HEAVY of the segments are found first, in blocks, and dealt over salts.
2. A segment's content (its words) is indexed once, at its first place. The others are its copies: every window
   that the index holds of them starts earlier, at that first place or before.
3. A shard concatenates its contents in order of document and position and keeps them as an FM-index alone: the
   Burrows-Wheeler transform in a wavelet matrix with counted 64-bit blocks, and every
   ``SAMPLE``-th text position. The words and the suffix array go. The contents are then streamed through
   it: matching statistics (for each place the longest match, up to ``WINDOW``, which occurs besides
   the place itself) by backward search. A window with a word that the index counts only once can't reach
   ``WINDOW`` and isn't begun. Where they reach it, the
   interval's positions are walked out by the last-to-first mapping, and the least tells if an
   earlier occurrence exists. Runs of such windows are reported.
4. The exact way for the rest: anchors with over ``HOT`` different contents (a passage's edges, beside
   ever other words) would make a shard too large, so their windows are grouped one by one
   by a 128-bit hash of their words, pre-aggregated, and all but the first place of a group are repeats.
5. Runs return to their documents, and covered words are taken out.

Words are compared as 64-bit hashes in the index; contents of equal anchors are grouped by a further 64-bit hash of their words.

Defined results: a null text has no words; a null doc_id is a document before all
others; rows that repeat a doc_id with other texts are documents ordered by their text's hash, and equal ones
among them count as one document; documents of under ``WINDOW`` words stay as they are; very long texts are taken
whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm.common import BLANKS, HEAVY, forget, keyed_join, sized_slices, slices, slots, stored, unrepeated

WINDOW = 20
GRAM = 4
#: Different contents of an anchor from which its windows are grouped singly, and words in a shard's index.
HOT = 2_000
SHARD = 200_000
#: Text positions for one that is kept.
SAMPLE = 8
#: Segments in which heavy anchors are sought at once.
BLOCK = 1 << 20
#: Tasks over which the segments of a heavy anchor are dealt.
SALTS = 1_024

_RNG = np.random.default_rng(5)
_COMBINE = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


_BASE = _RNG.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: For each byte whether it is part of a word; the lowest bytes of a 64-bit number; words of more bytes are hashed one by one.
_SOLID = bytes(chr(c) not in BLANKS for c in range(256))
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 64


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: a byte string splits at exactly the contract's blanks."""
    return (text or b"").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, one after the other, and each text's number of words.

    No word becomes an object: the bytes are cut at blanks all at once, and words taken up by eight bytes at a time.
    """
    ends = np.cumsum(np.array([0, *(len(t) + 1 for t in texts)]))
    data = b" ".join([b"", *texts, b" " * int(16 + (-1 - ends[-1]) % 8)])  # whole eights, and one past the last word's
    solid = np.frombuffer(data.translate(_SOLID), np.uint8)
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.frombuffer(data, "<u8")

    def taken(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        both = (eights[k] >> shift) | ((eights[k + 1] << np.uint64(1)) << (shift ^ np.uint64(63)))
        return both & _LOWEST[np.minimum(left, 8)]

    h = _mixed(taken(start, size) + size.astype(np.uint64) * _BASE)
    live, done = np.flatnonzero(size > 8), 8
    while len(live) and done < LONG:
        h[live] = _mixed(h[live] * _BASE ^ taken(start[live] + done, size[live] - done))
        done += 8
        live = live[size[live] > done]
    for i in live.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return h, np.diff(np.searchsorted(start, ends))


def segments(w: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window's start, number of windows) of each run of windows with one anchor in one place.

    w: the word hashes of documents of these lengths, one after the other; starts count from the first one's.
    Two equal windows never lie in one segment: their anchors' places would differ.
    """
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    gram = min(GRAM, window)
    g = np.zeros(len(w) - gram + 1, np.uint64)
    for j in range(gram):
        g += w[j : len(w) - gram + 1 + j] * _COMBINE[j]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    least, spot, width = g, np.arange(len(g)), window - gram + 1  # sliding minimum and its leftmost place, by doubling
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = slice(0, len(least) - step), slice(step, None)
        left = least[a] <= least[b]
        least, spot = np.where(left, least[a], least[b]), np.where(left, spot[a], spot[b])
        span += step
    whole = np.flatnonzero(owner[:n] == owner[window - 1 :])  # windows within one document
    spot, of = spot[whole], owner[whole]
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(whole)), bool), (spot[1:] != spot[:-1]) | (of[1:] != of[:-1])]))
    return least[whole[cut]].astype(np.int64), whole[cut], np.diff(np.append(cut, len(whole)))


def contents(w: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of words: the difference of prefix sums of powers, shifted to a common start."""
    powers = np.cumprod(np.full(len(w), _BASE, np.uint64))
    undo = np.cumprod(np.full(len(w), _INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers, dtype=np.uint64)])
    h = (sums[start + length] - sums[start]) * undo[start]
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


class WaveletMatrix:
    """A sequence of small integers as bit planes, each with counts before every 64-bit block."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.bits = len(values), max(1, int(top).bit_length())
        self.blocks, self.before, self.zeros = [], [], []
        v = values.astype(np.int32 if self.bits < 32 else np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = v & (1 << b) != 0
            block, before = bit_plane(bit)
            self.blocks.append(block)
            self.before.append(before)
            rest = v[~bit]
            self.zeros.append(len(rest))
            v = np.concatenate([rest, v[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, past the symbol's own start in the last plane."""
        at = at.astype(np.int64)
        for level in range(self.bits):
            ones = ones_before(self.blocks[level], self.before[level], at)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before, as ``rank`` has it."""
        at, symbol = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.blocks[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = ones_before(self.blocks[level], self.before[level], at)
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return symbol, at


def bit_plane(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in 64-bit blocks, and the ones before each block."""
    padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
    padded[: len(bit)] = bit
    block = np.packbits(padded, bitorder="little").view(np.uint64)
    return block, np.concatenate([[0], np.cumsum(np.bitwise_count(block).astype(np.int32))[:-1]]).astype(np.int32)


def ones_before(block: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = at >> 6
    return before[k] + np.bitwise_count(block[k] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places in order of the suffixes that start there, by prefix doubling from as many symbols as fit a number; only ties are sorted again."""
    n, bits = len(t), (int(t.max()) + 1).bit_length()
    k = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] += t[j:] + 1
    order, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    who = at = np.arange(n)  # suffixes to be sorted, and the places that they share out
    while True:
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(at)))
        rank[who] = np.repeat(at[first], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at) or k >= n:
            return order
        who = order[at]
        key = rank[who] * (n + 1) + np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
        k *= 2


class FMIndex:
    """Backward search over a text of integers which ends with its only 0, many patterns at once. The text isn't kept."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        top, sa = int(text.max()), suffix_array(text)
        self.n, self.sample = len(text), sample
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = WaveletMatrix(text[sa - 1], top)
        self.origin = self.wavelet.rank(np.arange(top + 1), np.zeros(top + 1, np.int64))
        marked = sa % sample == 0
        self.marks, self.before = bit_plane(marked)
        self.kept = sa[marked].astype(np.int32)

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of c before each pattern."""
        both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low, high]))
        shift = self.first[c] - self.origin[c]
        return both[: len(c)] + shift, both[len(c) :] + shift

    def matching(self, stream: np.ndarray, ends: np.ndarray, cap: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end in the stream how many of the words before it, at most cap, occur in the text ``least`` times or more, and their suffix interval.

        Ends with the same words so far share an interval, so a step extends each interval by each word before it once.
        """
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for step in range(1, cap + 1):
            live = live[ends[live] >= step]
            c = stream[ends[live] - step]
            if step == 1:
                a, b = self.first[c], self.first[c + 1]
            else:  # intervals of one length that start alike are one
                _, some, back = np.unique(low[live] * len(self.first) + c, return_index=True, return_inverse=True)
                a, b = (x[back] for x in self.extend(c[some], low[live[some]], high[live[some]]))
            more = b - a >= least
            live = live[more]
            if not len(live):
                break
            low[live], high[live], length[live] = a[more], b[more], step
        return length, low, high

    def positions(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back through the text until one whose position is kept."""
        at, out, live = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
        steps = np.zeros(len(at), np.int64)
        while len(live):
            r = at[live]
            known = (self.marks[r >> 6] >> (r & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            done = live[known]
            out[done] = self.kept[ones_before(self.marks, self.before, at[done])] + steps[done]
            live = live[~known]
            c, place = self.wavelet.access(at[live])
            at[live] = place + self.first[c] - self.origin[c]
            steps[live] += 1
        return out

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text position in each suffix interval."""
        if not len(low):
            return low
        pairs, back = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        sizes = pairs[1] - pairs[0]
        begin = np.cumsum(sizes) - sizes
        ranks = np.repeat(pairs[0] - begin, sizes) + np.arange(int(sizes.sum()))
        return np.minimum.reduceat(self.positions(ranks), begin)[back.reshape(-1)]


def repeated_windows(rows: list[tuple[bytes, int]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For different segments in order (word hashes, number of windows): runs of windows that occur earlier among them (segment, first window, number)."""
    coded = np.unique(np.frombuffer(b"".join([w for w, _ in rows]), np.uint64), return_inverse=True)[1].reshape(-1) + 2
    lengths = np.array([len(w) // 8 for w, _ in rows])
    counts = np.array([n for _, n in rows])
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(int((lengths + 1).sum()) + 1, np.int64)
    text[-1] = 0
    text[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(coded))] = coded
    index = FMIndex(text)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    single = np.concatenate([[0], np.cumsum(np.diff(index.first)[text] < 2)])
    some = np.flatnonzero(single[at + window] == single[at])
    length, low, high = index.matching(text, at[some] + window, window, 2)
    whole = length == window
    some, earlier = some[whole], np.zeros(len(at), bool)
    earlier[some] = index.earliest(low[whole], high[whole]) < at[some]
    begins, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(rows)), counts)
    edge = np.zeros(len(at) + 1, bool)
    edge[begins] = edge[-1] = True
    first = np.flatnonzero(earlier & (edge[:-1] | ~np.roll(earlier, 1)))
    last = np.flatnonzero(earlier & (edge[1:] | ~np.roll(earlier, -1)))
    return of[first], first - begins[of[first]], last - first + 1


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch's texts as hashes, and each text's number of words."""
    return word_hashes([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])


def heavy_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor): at most HEAVY, among them all that hold over 2/HEAVY of the segments.

    An anchor can't be over a share of the whole without being over it in some block, so blocks report
    what is over 1/HEAVY of theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            anchor, n = np.unique(np.concatenate(held), return_counts=True)
            total = int(n.sum())
            some = n * HEAVY > total
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([None, *anchor[some].tolist()], pa.int64()), pa.array([total, *n[some].tolist()], pa.int64())], ["anchor", "n"])

        for batch in sized_slices(batches, "text"):
            held.append(segments(*_hashed(batch), window)[0])
            if sum(map(len, held)) >= BLOCK:
                yield block()
        if held:
            yield block()

    found = stored(docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = found.where("anchor IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return found.where(F.col("anchor").isNotNull() & (F.col("n") * HEAVY > total)).select("anchor", F.lit(True).alias("heavy"))


def _segment_rows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, content, doc_id, row, start, n) of every segment: content hashes its words, row is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, "text"):
            w, lengths = _hashed(batch)
            anchor, start, n = segments(w, lengths, window)
            firsts = np.cumsum(lengths) - lengths
            of = np.searchsorted(np.cumsum(lengths), start, side="right")
            owner = pa.array(of)
            content = contents(w, start, n + (window - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(content), batch.column("doc_id").take(owner), batch.column("row").take(owner), pa.array((start - firsts[of] if len(of) else start).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "content", "doc_id", "row", "start", "n"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "anchor long, content long, doc_id long, row long, start int, n int")


def place() -> Column:
    """What orders occurrences; equal rows are one document and have equal places."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start")


def firsts_of(rows: DataFrame, key: list[str], label: str) -> tuple[DataFrame, int]:
    """Each key with its first place and how often it is met (stored), and all rows' number."""
    firsts = stored(rows.groupBy(*key).agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("times")), label)
    return firsts, firsts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]


def later_ones(rows: DataFrame, key: list[str], firsts: DataFrame, total: int) -> DataFrame:
    """(doc_id, row, start, n) of the rows that aren't the first of their key."""
    met = keyed_join(rows, firsts.where("times > 1").select(*key, "times", F.col("first").alias("f")), key, "times", total)
    return met.where(place() != F.col("f")).select("doc_id", "row", "start", "n")


def _with_words(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """asked (doc_id, row, spots of (anchor, start, n, hot)) -> (route, other, doc_id, row, start, n, words).

    A hot spot becomes a row for each window, its route and other a 128-bit hash of the words; the others carry their words.
    """
    want = asked.select(F.col("doc_id").alias("w_id"), F.col("row").alias("w_row"), "spots")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    met = rows.hint("merge").join(want, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row"))).select("doc_id", "row", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(unrepeated(batches, ["doc_id", "row"]), "text"):
            w, lengths = _hashed(batch)
            spots = batch.column("spots")
            of = np.repeat(np.arange(batch.num_rows), spots.value_lengths().to_numpy())
            anchor, start, n, hot = (spots.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "start", "n", "hot"))
            at = (np.cumsum(lengths) - lengths)[of] + start
            for cool in pieces(np.flatnonzero(~hot)):
                sizes = n[cool].astype(np.int64) + window - 1
                edges = np.cumsum(np.append(0, sizes))
                held = w[np.repeat(at[cool] - edges[:-1], sizes) + np.arange(edges[-1])]
                words = pa.Array.from_buffers(pa.binary(), len(cool), [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(held)])
                yield rows_of(batch, of[cool], anchor[cool], np.zeros(len(cool), np.int64), start[cool], n[cool], words)
            raw = w.tobytes()
            for some in pieces(np.flatnonzero(hot)):
                each = np.repeat(some, n[some])  # a row for each window
                i = np.arange(len(each)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                h = [xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + window)]) for a in (at[each] + i).tolist()]
                route, other = np.frombuffer(b"".join(h), ">i8").astype(np.int64).reshape(-1, 2).T
                yield rows_of(batch, of[each], route, other, start[each] + i, np.ones(len(each)), pa.nulls(len(each), pa.binary()))

    def pieces(which: np.ndarray) -> Iterator[np.ndarray]:
        for lo in range(0, len(which), 1 << 16):
            yield which[lo : lo + (1 << 16)]

    def rows_of(batch: pa.RecordBatch, of: np.ndarray, route: np.ndarray, other: np.ndarray, start: np.ndarray, n: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        owner = pa.array(of)
        cols = [pa.array(route), pa.array(other), batch.column("doc_id").take(owner), batch.column("row").take(owner), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), words]
        return pa.RecordBatch.from_arrays(cols, ["route", "other", "doc_id", "row", "start", "n", "words"])

    return met.mapInArrow(run, "route long, other long, doc_id long, row long, start int, n int, words binary")


def _search_shards(rows: DataFrame, shards: int, window: int) -> DataFrame:
    """(doc_id, row, start, n) of the runs of windows that occur earlier, from rows with words dealt by route."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("row"), F.col("start")]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(max(slots(rows.sparkSession), 1), "shard").sortWithinPartitions("shard", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answer() -> pa.RecordBatch:
            runs = repeated_windows([(h[4], h[3]) for h in held], window) if held else []
            out = [(*held[k][:2], held[k][2] + a, n) for k, a, n in zip(*(x.tolist() for x in runs), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "row", "start", "n"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "row", "start", "n", "words")), strict=True):
                if r[0] != at:
                    yield answer()
                    at, held = r[0], []
                if not held or held[-1][:3] != r[1:4]:  # what an equal row asked again is no other occurrence
                    held.append(r[1:])
        yield answer()

    return dealt.select("shard", "doc_id", "row", "start", "n", "words").mapInArrow(run, "doc_id long, row long, start int, n int")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, spans), stored: for each document the runs of windows (start, n) that occur earlier."""
    every = _segment_rows(docs, window).join(F.broadcast(heavy_anchors(docs, window)), "anchor", "left")
    salted = every.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(SALTS))).otherwise(0).cast("int"))
    met = salted.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("anchor", "salt")))
    named = stored(met.where(F.col("heavy") | (F.col("met") > 1)).select("anchor", "content", "doc_id", "row", "start", "n"), "segments")
    key = ["anchor", "content", "n"]
    firsts, total = firsts_of(named, key, "contents")
    size = firsts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("n") + window), F.lit(0)).alias("words")).first()
    crowded = stored(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT), "crowded")
    in_crowd = keyed_join(firsts, crowded, "anchor", "k", size["rows"]).select(*key, "first", F.lit(True).alias("hot"))
    line = max(1, size["rows"] // HEAVY)
    few = firsts.join(F.broadcast(crowded.where(F.col("k") > line).select("anchor")), "anchor", "left_anti")
    few = few.join(crowded.where(F.col("k") <= line).select("anchor").hint("merge"), "anchor", "left_anti").select(*key, "first", F.lit(False).alias("hot"))
    asked = few.unionByName(in_crowd).groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct("anchor", "first.start", "n", "hot")).alias("spots"))
    worded = stored(_with_words(docs, asked, window), "worded")
    singles = worded.where("words IS NULL").select("route", "other", "doc_id", "row", "start", "n")
    first_singles, n_singles = firsts_of(singles, ["route", "other"], "windows")
    shards = max(slots(docs.sparkSession), int(size["words"] // SHARD) + 1)
    found = _search_shards(worded.where("words IS NOT NULL"), shards, window)
    found = found.unionByName(later_ones(named, key, firsts, total)).unionByName(later_ones(singles, ["route", "other"], first_singles, n_singles))
    out = stored(found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "repeats")
    forget(named, firsts, crowded, worded, first_singles)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, n_removed): every row of docs with the words that stay, joined by one space."""
    spans = repeats(docs, window).select(F.col("doc_id").alias("s_id"), F.col("row").alias("s_row"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("row") == F.col("s_row")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, total, gone = [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                kept = words
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in found:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"] + window - 1] -= 1
                    kept = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                texts.append(b" ".join(kept))
                total.append(len(words))
                gone.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    return met.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")
