"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear classifier on hashed
words under the class-prior-corrected risk
``pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1))``; where the second term falls below
zero the step goes up its own gradient instead, so that the risk can't be driven
negative by fitting the unlabelled positives.

Both samples are bounded (``POSITIVES``, ``UNLABELLED``; the lowest hashes of doc_id)
and gathered as sparse counts, so the driver's share doesn't grow with the corpus.
Scoring is one pass over whole texts.

Defined results: a null text is empty; an empty text scores as its bias says; without
any positive example every score is 0; a null doc_id is scored and is never used to
learn; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import slices

#: Most examples of each kind that the classifier is fitted on.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Hashed words, and the most of them (the commonest among positives) that the classifier weighs.
SPACE, FEATURES = 1 << 18, 16_384
ROUNDS, RATE, DECAY = 2_000, 0.2, 1e-5
#: A word is weighed if so many positives have it, and so many times the share of them that it has of negatives. Negatives
#: are what is left of the unlabelled texts without their share of positives, so that the lift has no bound at any share.
LEAST, LIFT = 4, 2.0
#: Most words a worker remembers.
CACHE = 400_000

_WORD = re.compile(r"[^\W\d_]+")


class WordSlots(dict):
    """word -> hashed place."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        at = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE
        return at


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sparse(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, counts) of each text, for a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = WordSlots()
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                at: Counter = Counter()
                for w, n in word_counts(text).items():
                    at[place[w]] += n
                keys = sorted(at)
                out.append((np.array(keys, "<i4").tobytes(), np.array([at[k] for k in keys], "<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["at", "n"])

    got = rows.select("text").mapInArrow(run, "at binary, n binary")
    return [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in got.toLocalIterator()]


class Sparse:
    """A row-compressed matrix with the two products that training needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], column: np.ndarray):
        cols, vals, owner = [], [], []
        for i, (at, n) in enumerate(rows):
            c = column[at]
            keep = c >= 0
            cols.append(c[keep])
            vals.append(np.log1p(n[keep]))
            owner.append(np.full(int(keep.sum()), i))
        self.cols, self.vals, self.owner = (np.concatenate(x) if x else np.zeros(0) for x in (cols, vals, owner))
        self.cols, self.owner = self.cols.astype(np.int64), self.owner.astype(np.int64)
        self.shape = (len(rows), int(column.max()) + 1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.vals * w[self.cols], minlength=self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.vals * g[self.owner], minlength=self.shape[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Weights by hashed place (0 where a word isn't weighed) and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, positive: list, unlabelled: list, prior: float, rounds: int = ROUNDS) -> Model:
        if not positive or not unlabelled or prior <= 0:
            return cls(np.zeros(SPACE), -np.inf)
        prior = min(prior, 0.9)
        df_p, df_u = np.zeros(SPACE), np.zeros(SPACE)
        for rows, df in ((positive, df_p), (unlabelled, df_u)):
            for at, _ in rows:
                df[at] += 1
        df_n = np.maximum(df_u - prior * df_p * len(unlabelled) / len(positive), 0) / (1 - prior)
        lift = (df_p + 1) / (len(positive) + 2) / ((df_n + 1) / (len(unlabelled) + 2))
        chosen = np.flatnonzero((df_p >= LEAST) & (lift > LIFT))
        chosen = chosen[np.argsort(-df_p[chosen], kind="stable")[:FEATURES]]
        column = np.full(SPACE, -1, np.int64)
        column[chosen] = np.arange(len(chosen))
        if not len(chosen):
            return cls(np.zeros(SPACE), float(np.log(prior / (1 - prior))))
        p, u = Sparse(positive, column), Sparse(unlabelled, column)
        w, bias = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
        w = np.zeros(len(chosen))
        p.shape, u.shape = (p.shape[0], len(w)), (u.shape[0], len(w))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, rounds + 1):
            zp, zu = p.dot(w) + bias, u.dot(w) + bias
            sp, su = _sigmoid(zp), _sigmoid(zu)
            # logistic losses: softplus(-z) for +1, softplus(z) for -1
            negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
            g_plus, g_minus = -prior * (1 - sp) / len(zp), -prior * sp / len(zp)
            g_u = su / len(zu)
            if negative >= 0:
                gp, gu = g_plus + g_minus, g_u
            else:  # climb out: only the negative part, upwards
                gp, gu = -g_minus, -g_u
            grad = np.append(p.back(gp) + u.back(gu) + DECAY * w, gp.sum() + gu.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = RATE * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        weights = np.zeros(SPACE)
        weights[chosen] = w
        return cls(weights, float(bias))

    def score(self, text: str | None, place: WordSlots) -> float:
        if self.bias == -np.inf:
            return 0.0
        at: Counter = Counter()
        for word, n in word_counts(text).items():
            k = place[word]
            if self.weights[k]:
                at[k] += n
        z = self.bias + sum(self.weights[k] * np.log1p(n) for k, n in sorted(at.items()))
        return float(_sigmoid(np.array(z)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from rows that aren't held out: toxic ones as positives, others' text without their labels."""
    open_docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share")).first()["share"] or 0.0
    order = F.xxhash64("doc_id")
    toxic = open_docs.select("doc_id").join(marks.where("toxic = 1"), "doc_id", "left_semi").distinct().orderBy(order, "doc_id").limit(positives)
    others = open_docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled)
    picked = [F.broadcast(x) for x in (toxic, others)]  # bounded by the parameters
    return Model.fit(*(_sparse(open_docs.join(x, "doc_id", "left_semi")) for x in picked), share)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = WordSlots()
        for batch in slices(batches):
            scores = [model.score(t, place) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
