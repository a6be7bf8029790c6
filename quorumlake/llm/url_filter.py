"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones. Their lexical features (length,
depth, digit ratio, entropy, parameter counts, suffix statistics) train boosted
trees, which judge every URL without a rule. All of it is DataFrame expressions
and the DataFrame-based tree learner.

Training takes a bounded sample (``SAMPLE``, the lowest hashes of the URL); suffix
statistics are counted over all labelled URLs, for every suffix there is. Suffixes with over 1/HEAVY of
the URLs are joined by broadcast (at most HEAVY), the others by key.

Defined results: a null URL, or one without ``://``, has an empty host and path and
no rule; without labels of both kinds the method's verdict is the only kind there
is, or allow; a null page_id is passed through; repeated rows are judged each; very long URLs are judged whole; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import ascii_lower, keyed_join, stored

#: Most labelled URLs that the trees are fitted on, and the trees' size.
SAMPLE = 20_000
TREES, DEPTH, BINS = 12, 3, 32
#: Labelled URLs that the overall share weighs as much as in a suffix's statistics.
PRIOR = 20.0

FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_marks", "f_secure", "f_suffix_rate", "f_suffix_log"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # with its leading slash

    @property
    def shown(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_by_rules(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows (host, path) with ``rule`` and ``ruled``: the longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.shown), r.shown)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        name, verdict = F.when(fits, r.shown).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": name, "ruled": verdict})


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    return F.when(n > 0, -F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def with_features(rows: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return rows.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_depth": _count(F.col("path"), "/"),
        "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        "f_digits": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "f_entropy": _entropy(url),
        "f_params": F.when(F.instr(url, "?") > 0, _count(url, "&") + 1).otherwise(0.0),
        "f_marks": _count(url, "[-_%~.]"),
        "f_secure": F.startswith(url, F.lit("https")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, block_probability) of every row of pages."""
    rows = pages.select("page_id", "url")
    rows = with_features(judge_by_rules(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules))
    rows = rows.withColumn("label", (F.col("ruled") == "block").cast("double"))
    named = rows.where(F.col("ruled").isNotNull())
    totals = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    out = ["page_id", "url", "host", "path", "rule"]
    if not totals.n or totals.blocked in (0.0, float(totals.n)):
        only = "block" if totals.n and totals.blocked else "allow"
        return rows.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    share = totals.blocked / totals.n
    every = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("held"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))
    stats = stored(every.select("suffix", "held", ((F.col("blocked") + PRIOR * share) / (F.col("n") + PRIOR)).alias("f_suffix_rate"), F.log1p("n").alias("f_suffix_log")), "suffixes")
    total = stats.agg(F.sum("held")).first()[0]

    def known(frame: DataFrame) -> DataFrame:
        return keyed_join(frame, stats, "suffix", "held", total).drop("held")

    picked = named.orderBy(F.xxhash64("url"), "url", "page_id").limit(sample)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=7, stepSize=0.3, predictionCol="blocked")
    trees = trees._set(probabilityCol="chance", rawPredictionCol="raw")
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(known(picked).select(*FEATURES, "label"))
    judged = model.transform(known(rows))
    verdict = F.coalesce("ruled", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    from pyspark.ml.functions import vector_to_array

    return judged.select(*out, verdict.alias("verdict"), vector_to_array("chance")[1].alias("block_probability"))
