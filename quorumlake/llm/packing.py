"""Best-fit packing by the configuration linear program.

1. Tokenise every document (one Python pass), cut what exceeds ``capacity``
   and write the small piece rows to the shared folder.
2. Aggregate the length histogram: at most ``capacity`` rows, whatever the input.
3. On the driver, from the histogram alone: solve the covering LP over
   configurations (multisets of length classes that fit a sequence) with
   multiplicative weights, a knapsack dynamic programme pricing each round;
   round it; then best-fit the rest, length by length, into the gaps. Short lengths are
   priced in lots of equal pieces; the programme is solved with and without them, its configurations are
   rounded with the lots and with short pieces going one by one into the gaps, and the plan with the fewest sequences stays. Sequences with equal contents are one run, so the work
   doesn't depend on how many there are.
4. Rank the pieces of each length in salted groups and look their places up in the
   runs. A length that a third of the rows share is split over many groups.

Defined results: a null text is empty, and an empty text is the one end token;
a null doc_id is passed through; rows that repeat a doc_id are packed each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import array
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm.common import slices, slots, stored

CAPACITY = 4096
END_ID = 1
#: Lengths under 1/16 of a sequence enter the LP in lots: the fewest pieces of one length that make 1/16 of a sequence.
SMALL = 16
#: Tokens in a length class of the LP, rounds of multiplicative weights, and their step.
CLASS = 8
ROUNDS = 1500
STEP = 0.1
#: Most entries of a worker's cache of word ids; a full one starts anew.
CACHE = 400_000
#: Characters after which a text is cut at the next blank for tokenising.
CHUNK = 1 << 20

#: Letters, digits and white space up to U+00FF, and the word rule of the vocabulary file.
_LETTERS, _DIGITS, _SPACE = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORDS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTERS}{_DIGITS}]+")
_CUT = re.compile(r"[ \n\t\r]")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of lower-case words of Latin letters, as little-endian 32-bit bytes."""

    def __init__(self, model: object):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = self[word] = array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found


class Encoder:
    """text -> ids as bytes, equal to the tokenizer's own encode(text, add_special_tokens=False).

    Texts within U+00FF without marks of special tokens are cut into the vocabulary's
    words here and each word is encoded once; any other text goes through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordIds(self.tokenizer.model)

    def _chunk(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = "<|" not in text
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if len(text) <= CHUNK:
            return self._chunk(text)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, min(at + CHUNK, len(text)))
            end = cut.start() if cut else len(text)
            parts.append(self._chunk(text[at:end]))
            at = end
        return b"".join(parts)


@dataclass
class Placement:
    """Ranks [rank, rank + n) of a length: each sequence from ``sequence`` takes ``each`` of them at ``offset``."""

    length: int
    rank: int
    n: int
    each: int
    sequence: int
    offset: int


@dataclass
class Plan:
    placements: list[Placement] = field(default_factory=list)
    sequences: int = 0
    lp_value: float = 0.0
    lp_bound: float = 0.0

    def arrays(self) -> dict[int, np.ndarray]:
        """By length: rows (rank, each, sequence, offset), by rank."""
        by = defaultdict(list)
        for p in self.placements:
            by[p.length].append((p.rank, p.each, p.sequence, p.offset))
        return {k: np.array(sorted(v), np.int64).T for k, v in by.items()}


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset for a sequence: an unbounded knapsack by dynamic programming over the capacity.

    The best for up to 2k pieces is the best split of the capacity into two bests for up to k, all capacities at once.
    """
    counts = np.zeros(len(sizes), np.int64)
    order = np.argsort(values, kind="stable")
    order = order[sizes[order] <= capacity]
    if not len(order):
        return 0.0, counts
    item, one = np.full(capacity + 1, -1), np.zeros(capacity + 1)
    item[sizes[order]] = order  # the dearest of a size
    one[sizes[order]] = np.where(values[item[sizes[order]]] > 0, values[item[sizes[order]]], 0)
    best = np.maximum.accumulate(one)
    item = item[np.maximum.accumulate(np.where(one == best, np.arange(capacity + 1), 0))]
    half, splits = capacity // 2, []
    for _ in range((capacity // int(sizes.min()) - 1).bit_length()):
        rest = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(half, -np.inf), best]), half + 1)[:, ::-1]
        both = rest + best[: half + 1]
        splits.append(both.argmax(1))
        best = both[np.arange(capacity + 1), splits[-1]]
    rooms = [capacity]
    for split in reversed(splits):
        rooms = [r for room in rooms for r in (int(split[room]), room - int(split[room]))]
    for room in rooms:
        if item[room] >= 0:
            counts[item[room]] += 1
    return float(best[capacity]), counts


def solve_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[list[tuple[np.ndarray, float]], float, float]:
    """min sum(x) with every size's demand covered, by multiplicative weights on the covering rows.

    Returns configurations with their x, the value, and the best dual bound met.
    """
    weight, covered = np.ones(len(sizes)), np.zeros(len(sizes))
    found: dict[bytes, tuple[np.ndarray, float]] = {}
    bound = 0.0
    for _ in range(rounds):
        y = weight / demand
        value, counts = price(y / y.max(), sizes, capacity)
        bound = max(bound, float((y / y.max()) @ demand) / value)
        take = counts > 0
        amount = float((demand[take] / counts[take]).min())
        x = found.get(counts.tobytes(), (counts, 0.0))[1]
        found[counts.tobytes()] = (counts, x + amount)
        gain = counts * amount / demand
        covered += gain
        weight = weight * np.exp(-step * gain)
        weight = np.maximum(weight, weight.max() * 1e-12)
    low = covered.min()
    if low <= 0:  # too few rounds to meet each row: those rows get their own sequences when rounded
        low = max(1.0, float(np.median(covered)))
    out = [(c, x / low) for c, x in found.values()]
    return out, sum(x for _, x in out), bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Places for every piece of a length histogram."""
    left = {k: int(v) for k, v in histogram.items() if v}
    lots = {k: -(-capacity // (SMALL * k)) for k in left}
    classes: dict[tuple[int, bool], list[int]] = defaultdict(list)  # by rounded size and whether of lots
    for k in sorted(left):
        if left[k] >= lots[k]:
            classes[-(-k * lots[k] // CLASS), lots[k] > 1].append(k)
    made = []
    for keys in ([k for k in sorted(classes) if not k[1]], sorted(classes)):  # long pieces alone, then with lots
        tight = any(m[1].sequences * capacity - sum(k * n for k, n in left.items()) < capacity for m in made)  # no plan has fewer
        if keys and not tight and (not made or len(keys) > made[0][0]):
            sizes = np.array([s for s, _ in keys], np.int64)
            demand = np.array([sum(left[k] // lots[k] for k in classes[c]) for c in keys], float)
            configs, value, bound = solve_lp(sizes, demand, capacity // CLASS, rounds)
            # The fullest first, as far as its lengths last.
            configs = sorted(configs, key=lambda c: (-int(c[0] @ sizes), -c[1], c[0].tobytes()))
            wanted = [([(key, int(c)) for key, c in zip(keys, counts, strict=True) if c], x) for counts, x in configs]
            made.append((len(keys), _rounded(left, wanted, classes, lots, capacity), value, bound))
            if any(short for _, short in keys):  # lots are coarse: short pieces may do better in the gaps
                wanted = [([w for w in config if not w[0][1]], x) for config, x in wanted]
                made.append((len(keys), _rounded(left, wanted, classes, lots, capacity), value, bound))
    if not made:
        return _rounded(left, [], classes, lots, capacity)
    _, least, least.lp_value, least.lp_bound = min(made, key=lambda m: m[1].sequences)
    return least


def _rounded(histogram: dict[int, int], wanted: list, classes: dict, lots: dict, capacity: int) -> Plan:
    """Whole copies of each configuration [(class, how many)], x, and best fit for what they leave."""
    left, rank, made = dict(histogram), dict.fromkeys(histogram, 0), Plan()
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (first sequence, how many)

    def place(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        made.placements.append(Placement(length, rank[length], n, each, sequence, offset))
        rank[length] += n
        left[length] -= n

    for config, x in wanted:
        if config:
            have = min(sum(left[k] // lots[k] for k in classes[s]) // c for s, c in config)
            _copies(min(have, int(x) + (x % 1 >= 0.5)), config, classes, lots, left, place, made, gaps, capacity)
    _best_fit(left, gaps, made, place, capacity)
    return made


def _copies(copies: int, wanted: list, classes: dict, lots: dict, left: dict, place: Callable, made: Plan, gaps: dict, capacity: int) -> None:
    """Whole copies of one configuration. A class mixes lengths, so the copies split into runs of equal contents."""
    while copies > 0:
        chosen, run, spare = [], copies, {k: n // lots[k] for k, n in left.items()}
        for s, c in wanted:
            todo = c
            for k in sorted(classes[s], reverse=True):
                if todo and spare[k] > 0:
                    n = min(todo, max(1, spare[k] // run))
                    if spare[k] < n:
                        continue
                    chosen.append((k, n))
                    run = min(run, spare[k] // n)
                    todo -= n
            if todo:
                return
        at, sequence = 0, made.sequences
        made.sequences += run
        for k, n in chosen:
            place(k, run * n * lots[k], n * lots[k], sequence, at)
            at += n * lots[k] * k
        if at < capacity:
            gaps[capacity - at].append((sequence, run))
        copies -= run


def _best_fit(left: dict, gaps: dict, made: Plan, place: Callable, capacity: int) -> None:
    """Best-fit decreasing over runs of equal sequences: each length goes where the least room stays."""
    free = sorted(gaps)
    for length in sorted(left, reverse=True):
        at = bisect_left(free, length)
        while left[length] > 0:
            if at >= len(free):
                need = -(-left[length] // (capacity // length))
                runs, room = [(made.sequences, need)], capacity
                made.sequences += need
            else:
                room = free.pop(at)
                runs = gaps.pop(room)
            fits = room // length
            back = []
            for sequence, count in runs:
                n = left[length]
                full = min(count, n // fits)
                if full:
                    place(length, full * fits, fits, sequence, capacity - room)
                    _add(gaps, free, room - fits * length, (sequence, full))
                if full < count and (rest := left[length]) and rest < fits:
                    place(length, rest, rest, sequence + full, capacity - room)
                    _add(gaps, free, room - rest * length, (sequence + full, 1))
                    full += 1
                if full < count:
                    back.append((sequence + full, count - full))
            for r in back:
                _add(gaps, free, room, r)
            at = bisect_left(free, length)


def _add(gaps: dict, free: list, room: int, run: tuple[int, int]) -> None:
    if room > 0:
        if room not in gaps:
            free.insert(bisect_left(free, room), room)
        gaps[room].append(run)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = Encoder(vocabulary), array.array("I", [END_ID]).tobytes(), 4 * capacity
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                rows += [(doc, i, i * capacity, min(width, len(ids) - i * width) // 4, zlib.crc32(ids[i * width : (i + 1) * width])) for i in range(-(-len(ids) // width))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces (any columns with a length of 1 to capacity), each with sequence_id and offset.

    ``pieces`` is read twice and should be stored.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    made = plan(histogram, capacity, rounds)
    runs = made.arrays()
    group = max(64, sum(histogram.values()) // (8 * slots(spark)))
    salts = spark.createDataFrame([(k, -(-n // group)) for k, n in histogram.items()] or [(0, 1)], "length long, salts long")
    order = [F.col("doc_id"), F.col("piece")] if {"doc_id", "piece"} <= set(pieces.columns) else [F.xxhash64(*pieces.columns)]
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*order), "salts")).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    placed = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r")).drop("salt", "base", "r")
    names = [c for c in placed.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                start, each, seq, off = runs[int(k)]
                i = np.searchsorted(start, rank[at], side="right") - 1
                j = rank[at] - start[i]
                sequence[at], offset[at] = seq[i] + j // each[i], off[i] + j % each[i] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    return placed.mapInArrow(run, ", ".join([*(f"`{n}` {fields[n]}" for n in names), "sequence_id long, offset long"]))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` tokens."""
    return pack(stored(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)
