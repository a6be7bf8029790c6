"""Folders and archives of table files."""

from __future__ import annotations

import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.model import Refusal
from quorumlake.sources.delimited import read_delimited
from quorumlake.sources.parquet import read_parquet

TEXT = (".csv", ".tsv", ".txt")
#: Most bytes an archive's members may unpack to, and how many times their packed size.
MAX_UNPACKED, MAX_RATIO = 4 << 30, 200


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A table for each file of a flat folder, named by the file."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path").orderBy("path")
    out: dict[str, DataFrame] = {}
    for row in listed.collect():  # one row a file
        path = PurePosixPath(row["path"])
        if path.suffix.lower() in TEXT:
            out[path.stem] = read_delimited(spark, row["path"])
        elif path.suffix.lower() == ".parquet":
            out[path.stem] = read_parquet(spark, row["path"])
    return out


def safe_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Files of an archive; refused if a path leaves it or it unpacks to too much."""
    members = [m for m in archive.infolist() if not m.is_dir()]
    for m in members:
        path = PurePosixPath(m.filename)
        if path.is_absolute() or ".." in path.parts or "\\" in m.filename:
            raise Refusal("UNSAFE_ARCHIVE", m.filename)
        if m.file_size > MAX_RATIO * max(1, m.compress_size):
            raise Refusal("UNSAFE_ARCHIVE", f"{m.filename} unpacks to {m.file_size} bytes")
    if sum(m.file_size for m in members) > MAX_UNPACKED:
        raise Refusal("UNSAFE_ARCHIVE", "too large")
    return members


def read_archive(spark: SparkSession, path: str, into: str) -> dict[str, DataFrame]:
    """A zip of table files, unpacked into a folder that all executors see."""
    with zipfile.ZipFile(path) as archive:
        for m in safe_members(archive):
            archive.extract(m, into)
    return read_folder(spark, f"file://{into}")


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.col("path"), F.col("length").alias("bytes"))
