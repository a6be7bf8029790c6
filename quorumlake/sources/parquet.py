"""Parquet tables: import with the model's physical types, and the sink of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.model import Refusal

#: What imports as it is.
KEPT = {"bigint", "double", "string", "boolean", "date", "timestamp", "timestamp_ntz", "array<string>"}
WIDENED = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Integers and floats widened, decimals as text; nested and binary columns are refused."""
    frame = spark.read.parquet(path)
    out = []
    for name, kind in frame.dtypes:
        if kind in KEPT:
            out.append(F.col(name))
        elif kind in WIDENED:
            out.append(F.col(name).cast(WIDENED[kind]))
        elif kind.startswith("decimal"):
            out.append(F.col(name).cast("string").alias(name))
        else:
            raise Refusal("UNSUPPORTED_TYPE", f"{name}: {kind}")
    return frame.select(*out)


def write_table(frame: DataFrame, path: str) -> None:
    """A release's table: compressed Parquet, as many files as the frame has partitions."""
    frame.write.option("compression", "zstd").mode("error").parquet(path)
