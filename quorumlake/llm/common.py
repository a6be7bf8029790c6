"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII case folding of the contracts.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared_')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes the rows once as Parquet in the shared folder and reads them back.

    Unlike a cached frame it survives lost executors, and unlike an eager
    RDD checkpoint it computes the plan once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # once the table is written its shuffle files serve nobody
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes stored tables once what was made of them is stored itself.

    The driver collects its garbage then: until it does, it and the executors keep the broadcasts of the queries that are over.
    """
    jvm = None
    for t in tables:
        if (path := getattr(t, "_stored_at", None)) is not None:
            jvm, spark = t.sparkSession._jvm, t.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if jvm:
        jvm.System.gc()


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the unit in which work is dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so that a piece's Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            yield batch.slice(at, max_rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 256, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices that also hold no more than about max_bytes of a text column (a longer text stands alone)."""
    for batch in slices(batches, max_rows):
        ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right")) - at)
            yield batch.slice(at, n)
            at += n


#: At most so many keys can hold over 1/HEAVY of the rows each: those are broadcast.
HEAVY = 5_000


def keyed_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, weighed: bool = True) -> DataFrame:
    """Inner join with right (one row a key, with how many of left's rows it has): heavy keys by broadcast, the rest by key.

    The rest is always merged, so that the plan is the same at every size. Where left has the weights, they part its
    rows; else both parts look the heavy keys up, in one broadcast if all columns are used (weighed=False leaves the weight
    out): each broadcast costs the driver megabytes and a thread.
    """
    keys = [key] if isinstance(key, str) else key
    line = max(1, total // HEAVY)
    heavy, light = right.where(F.col(weight) > line), right.where(F.col(weight) <= line)
    if weight in left.columns:
        most = left.where(F.col(weight) > line).join(F.broadcast(heavy.drop(weight)), keys)
        return most.unionByName(left.where(F.col(weight) <= line).join(light.drop(weight).hint("merge"), keys))
    values = [c for c in right.columns if c not in keys and (weighed or c != weight)]
    met = left.join(F.broadcast(heavy.select(*keys, F.struct(values).alias("_heavy"))), keys, "left")
    rest = met.where("_heavy IS NULL").drop("_heavy")  # heavy rows are never dealt by their key
    most = met.where("_heavy IS NOT NULL").select(*keys, *[c for c in left.columns if c not in keys], *[F.col("_heavy")[c].alias(c) for c in values])
    return most.unionByName(rest.join(light.select(*keys, *values).hint("merge"), keys))


def unrepeated(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches without rows whose keys equal those of the row before them.

    Behind a merge join rows are in order of its keys, so equal rows go here without another shuffle.
    """
    last = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        fresh = [r != b for r, b in zip(rows, [last, *rows[:-1]], strict=True)]
        last = rows[-1] if rows else last
        yield batch if all(fresh) else batch.filter(pa.array(fresh))
