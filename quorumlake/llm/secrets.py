"""Secret scans: base rules plus formats learned by grammar inference.

1. One pass over the texts finds the base spans (three fixed rules), and all other tokens
   of ``MIN_ASSIGN`` characters or more, and their parts at ``=`` and ``/``, as candidates; both are stored.
2. The base spans' values are labelled credentials. A bounded sample of distinct
   values for each kind (``TRAIN``, the lowest hashes) builds a prefix tree over
   character classes whose statistically compatible states are merged (Hoeffding
   bounds) into a probabilistic automaton.
3. Every candidate is scored by its likelihood a character under the best
   automaton against a class bigram model of the candidates' own population,
   counted over the whole corpus. Those over ``MARGIN`` become spans of kind ``format``.

Base spans always stay; a learned span never overlaps one, nor another learned span.

Defined results: a null text is empty; a null or repeated doc_id is passed through;
without any labelled value nothing is learned and only base spans are returned;
texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quorumlake.llm.common import slices, stored

#: Most distinct labelled values of a kind from which its automaton is learned.
TRAIN = 2_000
#: Confidence of the merge test: states differ if a Hoeffding bound at this level says so.
ALPHA = 0.05
#: Log-likelihood ratio a character.
MARGIN = 0.35
#: Most class words whose scores a worker remembers.
CACHE = 200_000

#: The base rules. Letters of the assignment's names stand in either case.
_NAMES = "password passwd secret token api_?key".split()
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in _NAMES)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "format")

#: Candidates are as short as the values that the automata learn from.
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_ASSIGN},}}")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base rules, by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens which no base span overlaps, and their parts between '=' and '/', by start and then the longer first."""
    out = []
    base = merged((a, b) for _, a, b, _ in taken)
    starts = [a for a, _ in base]
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip(".=-")
        cuts = [-1, *(i for i, c in enumerate(token) if c in "=/")]
        spans = {(0, len(token)), *((a + 1, b) for a, b in zip(cuts, [*cuts[1:], len(token)], strict=True))}
        spans |= {(a + 1, len(token)) for a in cuts[1:]}
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            a, b = a + m.start(), b + m.start()
            if b - a >= MIN_ASSIGN:
                i = bisect_left(starts, b)  # base[:i] start before b; they don't overlap, so the last reaches furthest
                if not i or base[i - 1][1] <= a:
                    out.append((a, b, text[a:b]))
    return out


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, as spans apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _class_of(c: str) -> str:
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "l"
    if "A" <= c <= "F":
        return "H"
    if "G" <= c <= "Z":
        return "U"
    return c


_CLASSES = {chr(i): _class_of(chr(i)) for i in range(128)}


def classes(token: str) -> str:
    return "".join(_CLASSES.get(c, c) for c in token)


class Automaton:
    """A probabilistic automaton: ``next[state][symbol] -> (state, count)``; ``ends`` and ``visits`` by state."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]

    def _new(self) -> int:
        self.next.append({})
        self.count.append({})
        self.ends.append(0)
        self.visits.append(0)
        return len(self.next) - 1

    @classmethod
    def prefix_tree(cls, words: list[str]) -> Automaton:
        made = cls()
        for word in words:
            at = 0
            made.visits[0] += 1
            for c in word:
                if c not in made.next[at]:
                    made.next[at][c] = made._new()
                made.count[at][c] = made.count[at].get(c, 0) + 1
                at = made.next[at][c]
                made.visits[at] += 1
            made.ends[at] += 1
        return made

    def _apart(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states, and what follows them, could have the same distribution."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._apart(self.ends[a], self.visits[a], self.ends[b], self.visits[b], alpha):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._apart(self.count[a].get(c, 0), self.visits[a], self.count[b].get(c, 0), self.visits[b], alpha):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the subtree at b to the state a and what follows it."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, child in self.next[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    @classmethod
    def learn(cls, words: list[str], alpha: float = ALPHA) -> Automaton:
        """State merging: settled states take up compatible frontier states, others are settled."""
        made = cls.prefix_tree(words)
        settled, frontier = [0], [(0, c) for c in sorted(made.next[0])]
        while frontier:
            parent, c = frontier.pop(0)
            state = made.next[parent][c]
            if state in settled:
                continue
            for q in settled:
                if made.compatible(q, state, alpha):
                    made.next[parent][c] = q
                    made.fold(q, state)
                    break
            else:
                settled.append(state)
            known = set(settled)
            frontier = [(p, s) for p in settled for s in sorted(made.next[p]) if made.next[p][s] not in known]
        return made

    def log_likelihood(self, word: str) -> float:
        """With one spare count shared by all symbols, so that no word is impossible; after an unknown symbol the state stays."""
        total, at = 0.0, 0
        for c in word:
            total += math.log((self.count[at].get(c, 0) + 0.02) / (self.visits[at] + 1))
            at = self.next[at].get(c, at)
        return total + math.log((self.ends[at] + 0.02) / (self.visits[at] + 1))


def scan_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): base spans and candidates of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for batch in slices(batches):
            base, found = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append([{"kind": k, "start": a, "end": b, "value": v} for k, a, b, v in spans])
                found.append([{"start": a, "end": b, "value": v} for a, b, v in candidates(text or "", spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base array<struct<kind:string,start:int,end:int,value:string>>, found array<struct<start:int,end:int,value:string>>")


def labelled(scanned: DataFrame, per_kind: int = TRAIN) -> dict[str, list[str]]:
    """A bounded sample of distinct labelled credentials of each kind, the lowest hashes."""
    values = stored(scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct().withColumn("h", F.xxhash64("value")), "labelled")
    out: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        best = values.where(F.col("kind") == kind).orderBy("h", "value").limit(per_kind)
        if found := [r["value"] for r in best.select("value").collect()]:
            out[kind] = found
    return out


def background(scanned: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of class bigrams over all candidates of the corpus: at most the square of the classes."""
    pairs = scanned.select(F.explode("found").alias("f")).select(_class_column(F.col("f.value")).alias("c"))
    pairs = pairs.select(F.explode(F.expr("transform(sequence(1, length(c) - 1), i -> substring(c, i, 2))")).alias("pair"))
    return {(r["pair"][0], r["pair"][1]): r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


def _class_column(c):
    every = "".join(k for k in sorted(_CLASSES) if _CLASSES[k] != k)
    return F.translate(c, every, "".join(_CLASSES[k] for k in every))


class Scorer:
    """Log-likelihood ratio a character of a token: the best automaton against the background bigrams."""

    def __init__(self, automata: dict[str, Automaton], pairs: dict[tuple[str, str], int]):
        self.automata, self.pairs = automata, pairs
        self.total: dict[str, int] = defaultdict(int)
        for (a, _), n in pairs.items():
            self.total[a] += n
        self.known: dict[str, float] = {}

    def ordinary(self, word: str) -> float:
        return sum(math.log((self.pairs.get((a, b), 0) + 0.5) / (self.total[a] + 15)) for a, b in zip(word, word[1:], strict=False))

    def __call__(self, token: str) -> float:
        word = classes(token)
        if word not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            likely = max((a.log_likelihood(word) for a in self.automata.values()), default=-math.inf)
            self.known[word] = (likely - self.ordinary(word)) / len(word)
        return self.known[word]


def apart(hits: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of hits (start, end, score) that overlap, which are parts of one token, the best; the longer of equal ones."""
    out: list[tuple[int, int, float]] = []
    for a, b, v in sorted(hits, key=lambda h: (-h[2], h[0] - h[1], h[0])):
        i = bisect_left(out, (a, a, -math.inf))  # kept ones lie apart, in order: only the neighbours can overlap
        if (not i or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
            out.insert(i, (a, b, v))
    return out


def secret_scan(docs: DataFrame, per_kind: int = TRAIN, margin: float = MARGIN) -> DataFrame:
    """(doc_id, spans): every document's spans as (kind, start, end, score), base ones with a null score."""
    scanned = stored(scan_rows(docs), "secrets")
    automata = {k: Automaton.learn([classes(v) for v in vs]) for k, vs in labelled(scanned, per_kind).items()}
    score = Scorer(automata, background(scanned) if automata else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            rows = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(s["start"], KINDS.index(s["kind"]), s["end"], None) for s in base]
                hits = [(f["start"], f["end"], v) for f in found if (v := score(f["value"])) >= margin]
                spans += [(a, 3, b, v) for a, b, v in apart(hits)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "score": v} for a, k, b, v in sorted(spans, key=lambda s: s[:3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return scanned.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")
