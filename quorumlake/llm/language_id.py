"""Language ID by Bayesian evidence fusion.

Evidence for each text: hashed character trigrams (a naive Bayes model counted over all
labelled documents; every labelled language is kept, those with few texts smoothed
towards the whole corpus), the language its markup declares, its address suffix and a
prior of its host. Host priors are smoothed down a hierarchy, host -> domain ->
suffix -> everything, from expected counts gathered by grouped aggregation; a
row's own share is left out of the counts of every level.

A document's lang column is the label that the text model learns from; it is no evidence for the document
itself, whose source stands for its host. Pages bring all kinds of evidence.

A text is rejected where no evidence supports a language: no letters at all, or
no language with a posterior of ``ACCEPT`` or more.

Hot hosts: counts are partly aggregated before any shuffle; hosts that hold over
1/``HEAVY`` of the rows are at most ``HEAVY`` and are broadcast, the others joined by key.

Defined results: null or empty texts and texts without letters are rejected (null
language); null hosts, suffixes and declared languages are missing evidence;
without labelled texts everything is rejected; of languages that come out equal the first by name is taken; null ids are passed
through and repeated rows judged each; very long texts are taken whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import slices, stored

BUCKETS = 1 << 15
#: A text of this many trigrams or more counts as that many: neighbouring trigrams aren't independent.
EVIDENCE = 200.0
#: Rows of the level above that a level's prior weighs as much as.
STRENGTH = 10.0
ACCEPT = 0.5
HEAVY = 2_000
#: Stands for declared languages that no text is labelled with; no name of a language.
OTHER = "\x00"
#: Languages whose counts a task holds before it passes them on.
HELD = 64
#: Characters scored at once, so that a very long text takes bounded memory.
CHUNK = 1 << 20

_SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", re.I)
_LETTERS = re.compile(r"[^\W\d_]")


def page_text(page: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _SCRIPT.sub(" ", page or "")))


def declared_language(page: str | None) -> str | None:
    found = _LANG.search(page or "")
    return found[1].lower() if found else None


def trigram_counts(text: str) -> np.ndarray:
    """Counts by hashed trigram; a trigram belongs to the chunk it starts in, so the whole text counts."""
    out = np.zeros(BUCKETS, np.int64)
    low = f" {text.lower()} "
    for at in range(0, len(low), CHUNK):
        c = np.frombuffer(low[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(c) >= 3:
            h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return out


class TextModel:
    """Trigram log-probabilities by language: ``logs`` has a row for each bucket, 128 KiB for each language in all."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    @classmethod
    def train(cls, docs: DataFrame) -> TextModel:
        """Counts over all labelled rows; the driver gets languages x buckets sums.

        A trigram's share in a language is smoothed towards its share in the corpus with a weight of the language's
        distinct trigrams (Witten and Bell), so that few texts are enough and many are hardly changed.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}

            def passed_on() -> Iterator[pa.RecordBatch]:
                for lang, n in sums.items():
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
                sums.clear()

            for batch in slices(batches):
                if len(sums) > HELD:
                    yield from passed_on()
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += trigram_counts(text or "")
            yield from passed_on()

        known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
        counts = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        counts = stored(counts, "trigrams")
        keep = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        row, n = {lang: i for i, lang in enumerate(keep)}, np.zeros((BUCKETS, len(keep)), np.float32)
        for r in counts.toLocalIterator():
            n[r["bucket"], row[r["lang"]]] = r["n"]
        whole = n.sum(1, dtype=np.float64) + 0.5
        whole = (whole / whole.sum()).astype(np.float32)
        kinds = np.count_nonzero(n, axis=0).astype(np.float32)
        total = n.sum(0, dtype=np.float64).astype(np.float32)
        logs = np.log((n + kinds * whole[:, None]) / (total + kinds))
        return cls(keep, logs)

    def score(self, text: str) -> list[float] | None:
        """Tempered log-likelihood of each language, or none for a text without letters."""
        if not self.languages or not _LETTERS.search(text):
            return None
        n = trigram_counts(text)
        total = int(n.sum())
        at = np.flatnonzero(n)
        return list(map(float, n[at] @ self.logs[at] * (min(1.0, EVIDENCE / total) * 0.2)))


def posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def score_texts(units: DataFrame, model: TextModel, keys: list[str], is_page: bool) -> DataFrame:
    """keys of units with ``declared`` (from the markup for pages), the text's log-likelihoods and its posterior."""
    fields = {f.name: f.dataType.simpleString() for f in units.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            logs, post, declared = [], [], batch.column("declared").to_pylist()
            for i, raw in enumerate(batch.column("text").to_pylist()):
                if is_page:
                    declared[i] = declared_language(raw)
                s = model.score(page_text(raw) if is_page else raw or "")
                logs.append(s)
                post.append(None if s is None else posterior(np.array(s)).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64())), pa.array(post, pa.list_(pa.float64()))], [*keys, "declared", "logs", "post"]
            )

    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), "declared string, logs array<double>, post array<double>"])
    return units.select(*keys, "declared", "text").mapInArrow(run, schema)


def _smoothed(counts: Column, total: Column, above: Column, own: Column, is_own: Column) -> Column:
    """A level's prior without the row's own share (none below zero), drawn towards that of the level above."""
    rest = F.zip_with(counts, own, lambda n, x: F.greatest(n - x, F.lit(0.0)))
    return F.zip_with(rest, above, lambda n, p: (n + STRENGTH * p) / (F.greatest(total - is_own, F.lit(0.0)) + STRENGTH))


def _expected(scored: DataFrame, n: int, *keys: str) -> DataFrame:
    """keys, counts array<double>, total: expected texts of each language by grouped aggregation."""
    sums = [F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    return scored.groupBy(*keys).agg(*sums, F.count("post").cast("double").alias("total"), F.count(F.lit(1)).alias("rows")).select(*keys, F.array(*[F.col(f"s{i}") for i in range(n)]).alias("counts"), "total", "rows")


def host_counts(scored: DataFrame, n: int) -> DataFrame:
    """(h, rows) and for each level of a host (suffix, domain, host) its expected counts and their total."""
    suffixes = _expected(scored, n, "suffix").select(F.col("suffix").alias("s"), F.col("counts").alias("suffix_counts"), F.col("total").alias("suffix_total"))
    domains = _expected(scored, n, "suffix", "domain").join(suffixes, F.col("suffix").eqNullSafe(F.col("s")))
    domains = domains.select(F.col("suffix").alias("ds"), F.col("domain").alias("dd"), F.col("counts").alias("domain_counts"), F.col("total").alias("domain_total"), "suffix_counts", "suffix_total")
    hosts = _expected(scored, n, "suffix", "domain", "host").join(domains, F.col("suffix").eqNullSafe(F.col("ds")) & F.col("domain").eqNullSafe(F.col("dd")))
    return hosts.select(F.col("host").alias("h"), F.col("counts").alias("host_counts"), F.col("total").alias("host_total"), "domain_counts", "domain_total", "suffix_counts", "suffix_total", "rows")


def fuse(scored: DataFrame, model: TextModel) -> DataFrame:
    """scored (keys, host, domain, suffix, declared, logs, post) with lang, confidence, accepted and text_lang."""
    n, languages = len(model.languages), model.languages
    keys = [c for c in scored.columns if c not in ("logs", "post", "declared", "host", "domain", "suffix")]
    none = [F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("text_lang")]
    if not n:
        return scored.select(*keys, *none)
    seen = scored.where(F.col("declared").isNotNull()).withColumn("d", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(OTHER))
    table = {r["d"]: (r["counts"], r["total"]) for r in _expected(seen, n, "d").collect()}  # at most n + 1 rows
    marks = [*languages, OTHER]
    says = np.array([[(table[d][0][i] if d in table else 0.0) + (5.0 if d == languages[i] else 0.5) for i in range(n)] for d in marks])
    says = np.log(says / says.sum(0, keepdims=True))
    spoken = F.broadcast(scored.sparkSession.createDataFrame([(d, list(map(float, row))) for d, row in zip(marks, says, strict=True)], "d string, said array<double>"))
    mark = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), OTHER))
    scored = scored.withColumn("mark", mark).join(spoken, F.col("mark") == F.col("d"), "left").drop("mark", "d")
    priors = host_counts(scored, n)
    levels = [c for c in priors.columns if c.endswith(("_counts", "_total"))]
    whole = _expected(scored, n).first()
    rows = scored.agg(F.count(F.lit(1))).first()[0]
    line = max(1, rows // HEAVY)
    same = F.col("host").eqNullSafe(F.col("h"))
    heavy, light = priors.where(F.col("rows") > line).drop("rows"), priors.where(F.col("rows") <= line).drop("rows")
    # Rows of heavy hosts meet their prior by broadcast; only what finds none is joined by key.
    first = scored.join(F.broadcast(heavy), same, "left")
    rest = first.where(F.col("host_total").isNull()).drop("h", *levels).join(light, same, "left")
    joined = first.where(F.col("host_total").isNotNull()).unionByName(rest).drop("h")
    own = F.coalesce(F.col("post"), F.array(*[F.lit(0.0)] * n))
    is_own = F.when(F.col("post").isNull(), 0.0).otherwise(1.0)
    prior = F.array(*[F.lit(1.0 / n)] * n)
    for counts, total in ((F.array(*map(F.lit, whole["counts"])), F.lit(whole["total"])), *((F.col(f"{k}_counts"), F.col(f"{k}_total")) for k in ("suffix", "domain", "host"))):
        joined = joined.withColumn("prior", _smoothed(counts, total, prior, own, is_own))
        prior = F.col("prior")
    said = F.coalesce(F.col("said"), F.array(*[F.lit(0.0)] * n))
    logs = F.zip_with(F.zip_with(F.col("logs"), F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b), said, lambda a, b: a + b)
    out = joined.withColumn("total_logs", logs).withColumn("best", F.array_max("total_logs"))
    confidence = 1.0 / F.aggregate(F.transform("total_logs", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, b: a + b)
    names = F.array(*map(F.lit, languages))
    out = out.withColumn("confidence", F.coalesce(confidence, F.lit(0.0)))
    accepted = F.col("logs").isNotNull() & (F.col("confidence") >= ACCEPT)
    return out.select(
        *keys,
        F.when(accepted, F.element_at(names, F.array_position("total_logs", F.col("best")).cast("int"))).alias("lang"),
        "confidence",
        accepted.alias("accepted"),
        F.element_at(names, F.array_position("post", F.array_max("post")).cast("int")).alias("text_lang"),
    )


def document_units(docs: DataFrame) -> DataFrame:
    """A document's source stands for its host; it has no address and declares nothing."""
    return docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"),
        F.lit(None).cast("string").alias("declared"), "text",
    )


def page_units(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    known = F.length(host) > 0
    return pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("text_hash"),
        F.when(known, host).alias("host"), F.when(known, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))).alias("domain"),
        F.when(known, F.element_at(labels, -1)).alias("suffix"), F.lit(None).cast("string").alias("declared"), F.col("html").alias("text"),
    )


_KEYS = ["kind", "doc_id", "page_id", "text_hash", "host", "domain", "suffix"]


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row for each document and page: kind, doc_id, page_id, text_hash, lang, confidence, accepted, text_lang."""
    model = TextModel.train(docs)
    scored = score_texts(document_units(docs), model, _KEYS, False)
    if pages is not None:
        scored = scored.unionByName(score_texts(page_units(pages), model, _KEYS, True))
    return fuse(stored(scored, "language"), model)
