"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. In each run a set
chooses a few of its shingles by hashes that all sets share, so that similar sets choose
common ones; sets that chose the same shingle meet in a bucket. Buckets of up to
``SMALL`` are brute-forced by signature, larger ones are split again by the next level's choices, to
``DEPTH`` levels, and whatever is still large is brute-forced in blocks.

A large bucket first meets its representative (drawn by hash, another one in each bucket): members whose
signatures loosely agree with it are linked to it, and those that agree with it in ``STRONG`` places or more go no
deeper. What is similar to such a member is itself near enough to the representative to be linked
there: distances add up. So a group of near copies doesn't descend all levels in all runs.

Runs come in rounds of ``RUNS``. After each round but the first the share of its links whose ends were connected
before is the estimate of the recall so far; rounds are repeated until it is ``TARGET`` or more. A pair at the threshold
meets in a first-level bucket of a run with probability over 0.63 (``recall_of``), of a round with over 0.9996.

1. One pass makes each text's set key (128 bits), choices and a one-byte MinHash
   signature; the small result is stored. Texts with equal sets are one vertex from here on.
2. Buckets link sets whose signatures could belong to similar sets; the links'
   connected components are found by repeated minima with tables written between rounds.
3. Within each component every pair of sets is compared exactly in blocks of at most
   ``BLOCK`` sets and ``BLOCK_TOKENS`` shingles: links are counted, never emitted pair by pair; what leaves a
   block are counts and a spanning link for each set.
4. Connected components of those exact links are the classes.

Skew: equal texts collapse before anything is compared; keys that hold over
1/HEAVY of the rows are at most HEAVY and are joined by broadcast; large groups are
dealt out as pairs of blocks.

Defined results: a null text is empty; texts without words are copies of each
other; a text of one to four words is one shingle; a class is named by its least
doc_id that isn't null; a null doc_id is passed through; repeated rows count as copies; very long texts are taken
whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import forget, keyed_join, slices, slots, stored, unrepeated

SHINGLE = 5
THRESHOLD = 0.8
#: Runs in a round, levels of a run, and the share of a round's links that earlier rounds must have connected.
RUNS = 8
DEPTH = 4
TARGET = 0.999
SMALL = 64
BLOCK, BLOCK_TOKENS = 2_048, 1 << 22
SIGNATURE = 64
#: Signature places in which two sets must agree to be linked: 5 deviations under what the threshold leads to expect.
AGREE = 35
#: Places from which a set is settled by a representative: about a similarity of 0.75.
STRONG = 48
#: Places that a pair at the threshold is expected to agree in: such links are what the recall is measured on.
EXPECTED = 51
#: Rounds whose choices the first pass over the texts makes.
FIRST_ROUNDS = 2

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_COMBINE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixers(round_: int) -> np.ndarray:
    """The multipliers by which the runs of a round choose, a row for each run, a column for each level."""
    return np.random.default_rng([20, round_]).integers(1, 1 << 63, (RUNS, DEPTH), dtype=np.uint64) | np.uint64(1)


def recall_of(similarity: float, runs: int = RUNS, depth: int = 1, threshold: float = THRESHOLD) -> float:
    """Chance that sets of equal size meet in a bucket at a level of some run."""
    shared = 2 * similarity / (1 + similarity)
    once = 1 - np.exp(-shared / threshold)
    return float(1 - (1 - once**depth) ** runs)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(w))
    if not n:
        return w
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h += w[j : len(w) - n + 1 + j] * _COMBINE[j]
    return np.unique(_mixed(h))


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


#: Tokens times hash functions worked on at once.
_AT_ONCE = 1 << 20


def choices(tokens: np.ndarray, mix: np.ndarray, threshold: float = THRESHOLD) -> list[bytes]:
    """For each level the tokens that each run chooses, those whose hash is under 1 / (threshold * size).

    A level is a count byte for each run and then the chosen tokens' low 32 bits: shorter tokens can only make
    buckets larger, never part them, and what meets is compared exactly.
    """
    if not len(tokens):
        return [bytes(len(mix))] * DEPTH
    bar = np.uint64(min(2.0**64 - 2048, 2.0**64 / (threshold * len(tokens))))
    step = max(1, _AT_ONCE // len(tokens))
    out = []
    for level in range(DEPTH):
        counts, held = np.zeros(len(mix), np.uint8), []
        for at in range(0, len(mix), step):
            run, token = np.nonzero(tokens[None, :] * mix[at : at + step, level, None] < bar)
            counts[at : at + step] = np.bincount(run, minlength=len(counts[at : at + step]))
            held.append(tokens[token].astype(np.uint32))
        out.append(counts.tobytes() + np.concatenate(held).tobytes())
    return out


def signature(tokens: np.ndarray) -> bytes:
    """The low bytes of the least hashes under SIGNATURE functions."""
    if not len(tokens):
        return bytes(SIGNATURE)
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, _AT_ONCE // SIGNATURE)
    for at in range(0, len(tokens), step):
        least = np.minimum(least, (tokens[None, at : at + step] * _MULTIPLY[:, None]).min(1))
    return (_mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def levels(round_: int) -> list[str]:
    """The columns that hold a round's choices."""
    return [f"r{round_}c{level}" for level in range(DEPTH)]


def sets_of(docs: DataFrame, rounds: int = FIRST_ROUNDS) -> DataFrame:
    """(doc_id, text_hash, sid, size, sig, r0c0...) of every row: its set's key, how many shingles it has, signature and choices by round and level."""
    names, mixes = [c for r in range(rounds) for c in levels(r)], [mixers(r) for r in range(rounds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(2).to_pylist():
                tokens = shingle_set(text)
                rows.append((set_key(tokens), len(tokens), signature(tokens), *(c for m in mixes for c in choices(tokens, m))))
            cols = list(zip(*rows, strict=True)) or [[]] * (3 + len(names))
            types = [pa.binary(), pa.int32(), *[pa.binary()] * (1 + len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", "text_hash", "sid", "size", "sig", *names])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, sid binary, size int, sig binary, " + ", ".join(f"{c} binary" for c in names))


def with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (at_id, at_hash, ...) with the text of the row of docs with that doc_id and text hash."""
    texts = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_hash"), "text")
    return texts.hint("merge").join(wanted, F.col("t_id").eqNullSafe(F.col("at_id")) & (F.col("t_hash") == F.col("at_hash"))).drop("t_id", "t_hash")


def round_choices(distinct: DataFrame, docs: DataFrame, round_: int) -> DataFrame:
    """(sid, sig, the round's choices): made anew from a text of each set."""
    mix = mixers(round_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(unrepeated(batches, ["sid"])):
            made = list(zip(*(choices(shingle_set(t), mix) for t in batch.column("text").to_pylist()), strict=True)) or [[]] * DEPTH
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("sig"), *(pa.array(list(c), pa.binary()) for c in made)], ["sid", "sig", *levels(round_)])

    rows = with_texts(distinct.select("sid", "sig", "at_id", "at_hash"), docs).select("sid", "sig", "text")
    return rows.mapInArrow(run, "sid binary, sig binary, " + ", ".join(f"{c} binary" for c in levels(round_)))


def _nodes(rows: DataFrame, name: str) -> DataFrame:
    """rows (sid, choices in the column name[, at: array of (run, node)]) -> (sid, run, node) one level down: a row for each token chosen there.

    Without ``at`` every run starts from node 0.
    """
    top, in_round = "at" not in rows.columns, RUNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            owner, runs, nodes = [], [], []
            where = [None] * batch.num_rows if top else batch.column("at").to_pylist()
            for i, (chosen, at) in enumerate(zip(batch.column(name).to_pylist(), where, strict=True)):
                counts = np.frombuffer(chosen[:in_round], np.uint8).astype(np.int64)
                tokens = np.frombuffer(chosen[in_round:], np.uint32).astype(np.uint64)
                if top:
                    r, n, t = np.repeat(np.arange(in_round), counts), np.zeros(len(tokens), np.uint64), tokens
                else:
                    ends = np.cumsum(counts)
                    r = np.repeat(np.array([a["run"] for a in at]), counts[[a["run"] for a in at]])
                    n = np.repeat(np.array([a["node"] for a in at], np.int64).view(np.uint64), counts[[a["run"] for a in at]])
                    t = np.concatenate([tokens[ends[a["run"]] - counts[a["run"]] : ends[a["run"]]] for a in at])
                owner.append(np.full(len(t), i))
                runs.append(r)
                nodes.append(_mixed(_mixed(n ^ (r.astype(np.uint64) << np.uint64(40))) + t))
            if owner:
                sid = batch.column("sid").take(pa.array(np.concatenate(owner)))
                yield pa.RecordBatch.from_arrays([sid, pa.array(np.concatenate(runs).astype(np.int32)), pa.array(np.concatenate(nodes).view(np.int64))], ["sid", "run", "node"])

    return rows.select("sid", name, *([] if top else ["at"])).mapInArrow(run, "sid binary, run int, node long")


def _agreement(rows: DataFrame) -> DataFrame:
    """rows (sid, run, node, n, sig, rep, rep_sig) -> (sid, run, node, n, rep, agree): in how many places the signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig", "rep_sig"))
            agree = pa.array((a == b).sum(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", "run", "node", "n", "rep")), agree], ["sid", "run", "node", "n", "rep", "agree"])

    return rows.select("sid", "run", "node", "n", "sig", "rep", "rep_sig").mapInArrow(run, "sid binary, run int, node long, n long, rep binary, agree int")


def bucket_links(distinct: DataFrame, round_: int) -> DataFrame:
    """(a, b, sure), stored: links between sets that met in a bucket of the round's runs and whose signatures agree; a spanning set of each bucket's.

    Sure ones agree in EXPECTED places or more.

    distinct: a row for each set with sid, sig and the round's choices.
    """
    sigs, rows, leaves, links, used = distinct.select("sid", "sig"), distinct, None, None, []
    for level, name in enumerate(levels(round_)):
        met = stored(_nodes(rows, name), "nodes")  # counted and joined from: made once
        drawn = F.xxhash64("node", "sid")
        counts = stored(met.groupBy("run", "node").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("least")).where("n > 1"), "buckets")
        large = F.col("n") > SMALL
        size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("large")).first()
        kept = stored(keyed_join(met.select("sid", "node"), counts, "node", "n", size["all"]), "met")
        used += [met, counts, kept]
        ready = kept.where(~large).select("sid", "node", "n")
        leaves = ready if leaves is None else leaves.unionByName(ready)
        if not size["large"]:
            break
        heads = kept.where(large & (drawn == F.col("least"))).select("node", "n", "sid").dropDuplicates(["node"])
        heads = stored(heads.join(sigs, "sid").select("node", "n", F.col("sid").alias("rep"), F.col("sig").alias("rep_sig")), "heads")
        others = keyed_join(kept.where(large).select("sid", "run", "node", "n"), heads, "node", "n", size["large"])
        seen = stored(_agreement(others.hint("merge").join(sigs, "sid")), "seen")
        used += [heads, seen]
        near = seen.where((F.col("agree") >= AGREE) & (F.col("sid") != F.col("rep"))).select(F.col("sid").alias("a"), F.col("rep").alias("b"), (F.col("agree") >= EXPECTED).cast("long").alias("sure"))
        links = near if links is None else links.unionByName(near)
        open_ = seen.where(F.col("agree") < STRONG)
        if level == DEPTH - 1:
            leaves = leaves.unionByName(open_.select("sid", "node", "n"))
        else:
            # What is split further meets its next choices once for each set: only that level's, only a row a set.
            spots = open_.groupBy("sid").agg(F.collect_list(F.struct("run", "node")).alias("at"))
            rows = stored(spots.hint("merge").join(distinct.select("sid", levels(round_)[level + 1]), "sid"), "frontier")
            used.append(rows)
    leaves = leaves.withColumn("parts", F.ceil(F.col("n") / (4 * 512)).cast("int"))
    found = _grouped(leaves.hint("merge").join(sigs, "sid"), "node", _signature_links, "a binary, b binary, sure long", ["sid", "sig"])
    out = stored((found if links is None else found.unionByName(links)).groupBy("a", "b").agg(F.max("sure").alias("sure")), "links")
    forget(*used)
    return out


def linked_sets(distinct: DataFrame, docs: DataFrame, target: float = TARGET) -> tuple[DataFrame, float]:
    """(sid, comp) of the sets that some round linked, and the recall reached: rounds are repeated until a round's links were connected before to a share of target."""
    round_, recall = 0, 0.0
    first = bucket_links(distinct, 0)
    labels = components(first)
    forget(first)
    while recall < target:
        round_ += 1
        rows = distinct if round_ < FIRST_ROUNDS else stored(round_choices(distinct, docs, round_), "choices")
        more = bucket_links(rows, round_)
        size = more.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("sure"), F.lit(0)).alias("sure")).first()
        tops = more.groupBy("b").agg(F.count(F.lit(1)).alias("k")).join(labels.select(F.col("sid").alias("b"), F.col("comp").alias("known")), "b", "left")
        tops = stored(tops.select("b", "k", F.coalesce("known", "b").alias("comp_b")), "tops")
        ends = keyed_join(more, tops, "b", "k", size["all"], weighed=False).join(labels.select(F.col("sid").alias("a"), F.col("comp").alias("comp_a")), "a", "left")
        fresh = stored(ends.select("sure", "b", F.col("a").alias("sid"), F.coalesce("comp_a", "a").alias("comp_a"), "comp_b").where("comp_a != comp_b"), "fresh")
        new = fresh.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("sure"), F.lit(0)).alias("sure")).first()
        recall = 1 - new["sure"] / size["sure"] if size["sure"] else 1.0
        if new["all"]:
            # What was linked before moves to its component's new name; sets that no round had linked come in.
            merged = components(fresh.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
            old, named = labels, merged.select(F.col("sid").alias("comp"), F.col("comp").alias("now"))
            moved = labels.join(named, "comp", "left").select("sid", F.coalesce("now", "comp").alias("comp"))
            lone = merged.join(labels, "sid", "left_anti").join(labels.select(F.col("comp").alias("sid")).distinct(), "sid", "left_anti")
            labels = stored(moved.unionByName(lone), "labels")
            forget(old, merged)
        forget(more, tops, fresh, rows if round_ >= FIRST_ROUNDS else None)
    return labels, recall


def _grouped(rows: DataFrame, key: str, work, schema: str, columns: list[str]) -> DataFrame:
    """work(first block's rows, second block's or None) on each group of rows (key, parts, columns), groups of several parts as pairs of blocks."""
    own = F.pmod(F.xxhash64(columns[0]), "parts").cast("int")
    rows = rows.withColumn("own", F.when(F.col("parts") > 1, own).otherwise(0))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")))
    rows = rows.withColumn("pair", F.explode(pair)).select(key, "pair.i", "pair.j", "own", *columns)
    n = max(slots(rows.sparkSession), 1)
    dealt = rows.repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        at, held, out = None, [], []

        def flush() -> None:
            first = [r for r in held if r[0] == at[1]]
            second = None if at[1] == at[2] else [r for r in held if r[0] == at[2]]
            out.extend(work([r[1:] for r in first], None if second is None else [r[1:] for r in second]))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            types = [pa.binary() if "binary" in c else pa.int64() for c in schema.split(",")]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (key, "i", "j", "own", *columns)]
            for row in zip(*cols, strict=True):
                if row[:3] != at:
                    if at is not None:
                        flush()
                    at, held = row[:3], []
                held.append(row[3:])
            if len(out) > 5000:
                yield batch_of()
        if at is not None:
            flush()
        yield batch_of()

    return dealt.mapInArrow(run, schema)


def _signature_links(first: list[tuple], second: list[tuple] | None) -> list[tuple]:
    """Spanning links among rows (sid, sig) whose signatures agree in AGREE places, and whether in EXPECTED: those come first."""
    rows = sorted(set(first)) if second is None else sorted(set(first)) + sorted(set(second))
    if len(rows) < 2:
        return []
    sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, SIGNATURE)
    tree, out, loose = Union(len(rows)), [], []
    for at in range(0, len(rows), 64):
        agree = (sig[at : at + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.uint8) if len(rows) <= 512 else _agreeing(sig[at : at + 64], sig)
        for i, j in zip(*(x.tolist() for x in np.nonzero(agree >= AGREE)), strict=True):
            if at + i < j:
                if agree[i, j] < EXPECTED:
                    loose.append((at + i, j))
                elif tree.join(at + i, j):
                    out.append((rows[at + i][0], rows[j][0], 1))
        if len(loose) > 1 << 20:  # those that the sure links connect are of no use
            loose = [(i, j) for i, j in loose if tree.top(i) != tree.top(j)]
    out += [(rows[i][0], rows[j][0], 0) for i, j in loose if tree.join(i, j)]
    return out


def _agreeing(some: np.ndarray, sig: np.ndarray) -> np.ndarray:
    n = np.zeros((len(some), len(sig)), np.uint8)
    for c in range(SIGNATURE):
        n += some[:, c, None] == sig[None, :, c]
    return n


class Union:
    def __init__(self, n: int):
        self.above = list(range(n))

    def top(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def components(links: DataFrame) -> DataFrame:
    """(sid, comp): the least sid of each linked set's component.

    Each round every vertex takes the least label among its neighbours' and its own, and then its
    label's label, so rounds grow with the logarithm of the widest component; a table is
    written after each round.
    """
    links = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = links.count()
    labels = stored(links.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("deg")).select("sid", F.least("sid", "least").alias("comp"), "deg"), "labels")
    while total:
        near = keyed_join(links.withColumnRenamed("a", "sid"), labels.select("sid", "comp", "deg"), "sid", "deg", total, weighed=False).groupBy(F.col("b").alias("sid")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "sid").select("sid", F.least("comp", "near").alias("mid"), F.col("comp").alias("was"), "deg")
        stepped, old = stored(stepped, "stepped"), labels
        sizes = stepped.groupBy("mid").agg(F.count(F.lit(1)).alias("k")).join(stepped.select(F.col("sid").alias("mid"), F.col("mid").alias("up")), "mid", "left")
        after = keyed_join(stepped, sizes, "mid", "k", total, weighed=False)
        labels = stored(after.select("sid", F.least("mid", F.coalesce("up", "mid")).alias("comp"), "was", "deg"), "labels")
        moved = labels.where(F.col("comp") != F.col("was")).limit(1).count()
        forget(old, stepped)
        if not moved:
            break
    forget(links)
    out = labels.select("sid", "comp")
    out._stored_at = labels._stored_at
    return out


def _dense_overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, over the tokens that both lists hold."""
    if a is b:
        tokens, often = np.unique(np.concatenate(a), return_counts=True)
        shared = tokens[often > 1]
    else:
        shared = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = np.concatenate(sets)
        at = np.searchsorted(shared, every)
        at[at == len(shared)] = 0
        here = shared[at] == every if len(shared) else np.zeros(len(every), bool)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[here]
        order = np.argsort(at[here], kind="stable")
        at = at[here][order]
        return at, owner[order], np.searchsorted(at, np.arange(0, len(shared) + 4096, 4096))

    out = np.zeros((len(a), len(b)), np.float32)
    pa_ = places(a)
    pb_ = pa_ if a is b else places(b)

    def part(p: tuple, n: int, k: int) -> np.ndarray:
        m = np.zeros((n, min(4096, len(shared) - 4096 * k)), np.float32)
        rows = slice(p[2][k], p[2][k + 1])
        m[p[1][rows], p[0][rows] - 4096 * k] = 1
        return m

    for k in range(-(-len(shared) // 4096)):
        first = part(pa_, len(a), k)
        out += first @ (first if a is b else part(pb_, len(b), k)).T
    return out


def _exact_links(first: list[tuple], second: list[tuple] | None) -> list[tuple]:
    """(sid, other, links) of rows (sid, copies, text): links counted with copies; other is a spanning link or the set itself."""
    def load(rows: list[tuple]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
        held = {}
        for sid, copies, text in rows:
            if sid not in held:
                tokens = shingle_set(text)
                if set_key(tokens) == sid:  # a doc_id with several texts brings some that aren't this set's
                    held[sid] = (copies, tokens)
        keys = sorted(held)
        return keys, np.array([held[k][0] for k in keys], np.int64), [held[k][1] for k in keys]

    ka, na, sa = load(first)
    kb, nb, sb = (ka, na, sa) if second is None else load(second)
    if not ka or not kb or second is None and len(ka) < 2:
        return []
    both = _dense_overlap(sa, sb) if len(ka) * len(kb) > 64 else np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in sb] for x in sa], np.float32)
    la, lb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
    near = both.astype(np.float64) >= THRESHOLD * (la[:, None] + lb[None, :] - both.astype(np.float64)) - 1e-9
    if second is None:
        np.fill_diagonal(near, False)
        tree = Union(len(ka))
        for i, j in zip(*np.nonzero(near), strict=True):
            tree.join(int(i), int(j))
        return [(k, ka[tree.top(i)], int(near[i] @ na)) for i, k in enumerate(ka) if near[i].any()]
    tree = Union(len(ka) + len(kb))
    for i, j in zip(*np.nonzero(near), strict=True):
        tree.join(int(i), len(ka) + int(j))
    keys = ka + kb
    counts = [*(near @ nb), *(near.T @ na)]
    return [(k, keys[tree.top(i)], int(counts[i])) for i, k in enumerate(keys) if counts[i]]


def near_duplicates(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, comp, text_hash) of every row of docs.

    Links join rows with a Jaccard similarity of THRESHOLD or more, copies included; classes are
    their connected components; class_id is a class's least doc_id, comp names it where that is null too.
    """
    sets = stored(sets_of(docs), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    copies = sets.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min(row).alias("at"), F.max("size").alias("size"))
    copies = stored(copies.select("sid", "copies", "first_id", "size", F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash")), "copies")
    made = sets.where("size > 0").select("sid", "sig", *[c for r in range(FIRST_ROUNDS) for c in levels(r)]).dropDuplicates(["sid"])
    distinct = stored(copies.select("sid", "at_id", "at_hash").join(made, "sid"), "distinct")
    labels, _ = linked_sets(distinct, docs, target)
    known = labels.join(copies.select("sid", "copies", "size", "at_id", "at_hash"), "sid")
    sizes = known.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    members = stored(keyed_join(known, sizes.select("comp", "n", parts.alias("parts")), "comp", "n", copies.count(), weighed=False), "members")
    exact = stored(_grouped(with_texts(members, docs), "comp", _exact_links, "sid binary, other binary, links long", ["sid", "copies", "text"]), "exact")
    linked = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(exact.where(F.col("sid") != F.col("other")).select(F.col("sid").alias("a"), F.col("other").alias("b")))
    info = copies.join(classes, "sid", "left").join(linked, "sid", "left").select("sid", "copies", "first_id", F.coalesce("comp", "sid").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    info = stored(info, "info")
    forget(distinct, members, exact, labels, classes, copies)
    named = info.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("k"))
    total = info.count()
    whole = keyed_join(info.select("sid", "copies", "comp", "n_links"), named, "comp", "k", total, weighed=False)
    rows = sets.select("doc_id", "text_hash", "sid")
    return keyed_join(rows, whole, "sid", "copies", total, weighed=False).select("doc_id", "class_id", "class_size", "n_links", "comp", "text_hash")


def one_of_each(classes: DataFrame) -> DataFrame:
    """Rows of ``near_duplicates`` with ``stays``: whether it is its class's row with the least (doc_id, text_hash), a null id last.

    Only rows that are equal in both can stay together.
    """
    ids = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = stored(classes.groupBy("comp").agg(F.min(ids).alias("first"), F.count(F.lit(1)).alias("k")), "first")
    return keyed_join(classes, first, "comp", "k", classes.count(), weighed=False).withColumn("stays", ids == F.col("first")).drop("first")
