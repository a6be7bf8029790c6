"""Inference over imported text: datatypes, missing codes, categories, keys and references.

Every test of a table's columns is one aggregation over its rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.cells import parsed

#: Texts that conventionally stand for a missing value, and the order in which datatypes are tried.
MISSING = ("", "NA", "N/A", "n/a", "na", "NaN", "nan", "null", "NULL", "None", "none", "-", "?")
TRIED = ("integer", "number", "date", "datetime", "boolean")
#: Cells from which one in this many may fail to parse, and the bounds of categories and identifiers.
TOLERANT_FROM, TOLERANCE, MAX_CATEGORIES, LEAST_IDENTIFIERS = 20, 20, 50, 20
DELIMITERS = (";", "|")


def profile(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, cells, missing, distinct, n_<datatype>...): one aggregation over all columns."""
    names = list(columns or frame.columns)
    aggregates: list[Column] = []
    for i, name in enumerate(names):
        c = F.col(name).cast("string")
        real = ~F.trim(c).isin(*MISSING) & c.isNotNull()
        aggregates += [F.count_if(real).alias(f"cells{i}"), F.count_if(~real | c.isNull()).alias(f"missing{i}"), F.count_distinct(F.when(real, c)).alias(f"distinct{i}")]
        aggregates += [F.count_if(real & parsed(c, kind).isNotNull()).alias(f"{kind}{i}") for kind in TRIED]
        aggregates += [F.count_if(real & c.contains(d)).alias(f"list{k}_{i}") for k, d in enumerate(DELIMITERS)]
    row = frame.agg(*aggregates)
    shown = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in ("cells", "missing", "distinct")], *[F.col(f"{k}{i}").alias(f"n_{k}") for k in TRIED], *[F.col(f"list{k}_{i}").alias(f"n_list{k}") for k in range(len(DELIMITERS))])
        for i, n in enumerate(names)
    ]
    return row.select(F.explode(F.array(*shown)).alias("p")).select("p.*")


def datatypes(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, datatype): the first datatype that parses all cells, or all but one in twenty of twenty or more."""
    p = profile(frame, columns)
    allowed = F.when(F.col("cells") >= TOLERANT_FROM, F.floor(F.col("cells") / TOLERANCE)).otherwise(0)
    kind = F.lit(None).cast("string")
    distinct_all = (F.col("cells") >= LEAST_IDENTIFIERS) & (F.col("distinct") == F.col("cells"))
    lists = [(F.col(f"n_list{k}") * 2 >= F.col("cells")) & (F.col(f"n_list{k}") > 0) for k in range(len(DELIMITERS))]
    few = (F.col("distinct") <= MAX_CATEGORIES) & (F.col("distinct") * 2 <= F.col("cells"))
    kind = F.when(lists[0] | lists[1], "list<category>").when(distinct_all, "string").when(few, "category").otherwise("string")
    for name in reversed(TRIED):
        kind = F.when((F.col("cells") > 0) & (F.col("cells") - F.col(f"n_{name}") <= allowed), name).otherwise(kind)
    return p.select("column", kind.alias("datatype"))


def key_candidates(frame: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, is_key): columns without nulls whose values all differ."""
    names = list(columns or frame.columns)
    row = frame.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(names)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"d{i}") == F.col("n")).alias("is_key")) for i, c in enumerate(names)])).alias("k")).select("k.*")


def contained(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(n_values, n_missing): distinct values of a column, and how many the key doesn't hold; a reference if 0."""
    values = child.select(F.col(column).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    keys = parent.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return values.join(keys, F.col("_v") == F.col("_k"), "left").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("_hit").isNull()).alias("n_missing"))


def references(tables: dict[str, DataFrame], keys: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(child, column, parent, key) of columns that fit in exactly one parent's key; integers also need a like name."""
    found = []
    for child, frame in tables.items():
        for column, kind in frame.dtypes:
            fits = []
            for parent, key in keys.items():
                key_kind = dict(tables[parent].dtypes)[key]
                alike = column.split("_")[-1] == key.split("_")[-1]
                if parent != child and kind == key_kind and kind in ("string", "bigint", "int") and (kind == "string" or alike):
                    r = contained(frame, column, tables[parent], key).first()
                    if r["n_values"] and not r["n_missing"]:
                        fits.append((child, column, parent, key))
            if len(fits) == 1:
                found += fits
    return found


def column_statistics(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, n, n_null, distinct, lo, hi) as text: one aggregation over a table."""
    names = list(columns)
    row = frame.agg(*[a for i, c in enumerate(names) for a in (F.count(F.col(c)).alias(f"n{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.count_distinct(F.col(c)).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(v) for k, v in (("n", "n"), ("z", "n_null"), ("d", "distinct"), ("lo", "lo"), ("hi", "hi"))]) for i, c in enumerate(names)])).alias("s")).select("s.*")


def unpivoted(matrix: DataFrame, keys: list[str], name: str, value: str, absent: Iterable[str] = MISSING) -> DataFrame:
    """A matrix's cells as rows, without those that are absent."""
    rest = [c for c in matrix.columns if c not in keys]
    long = matrix.unpivot(keys, rest, name, value)
    return long.where(F.col(value).isNotNull() & ~F.trim(F.col(value).cast("string")).isin(*absent))
