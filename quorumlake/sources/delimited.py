"""Delimited text: what it is written in is sniffed on a prefix, the rows are read by Spark."""

from __future__ import annotations

import codecs
import csv
import io
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 1 << 20
RECORDS = 1_000
#: Encodings in the order tried, and delimiters.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
DELIMITERS = (",", "\t", ";", "|")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


@dataclass(frozen=True)
class Format:
    encoding: str
    delimiter: str
    skip: int  # rows before the header


def detect(data: bytes, delimiter: str | None = None) -> Format:
    """From the first bytes of a file."""
    encoding = next((e for mark, e in MARKS if data.startswith(mark)), None)
    for candidate in (encoding,) if encoding else ENCODINGS:
        try:
            text = data.decode(candidate)
        except UnicodeDecodeError as e:
            if len(data) < PREFIX or e.end < len(data) - 4:  # else the prefix cuts a character
                continue
            text = data[: e.start].decode(candidate)
        encoding = candidate
        break
    best, width = delimiter or ",", 1
    for d in (delimiter,) if delimiter else DELIMITERS:
        rows = list(zip(range(RECORDS), csv.reader(io.StringIO(text), delimiter=d), strict=False))
        modal = Counter(len(r) for _, r in rows if r).most_common(1)
        if modal and modal[0][0] > width:
            best, width = d, modal[0][0]
    skip = 0
    for row in csv.reader(io.StringIO(text), delimiter=best):
        if len(row) == width and not (row and row[0].startswith("#")):
            break
        skip += 1
    return Format(encoding or "latin-1", best, skip)


def prefix_of(spark: SparkSession, path: str) -> bytes:
    """The first megabyte of the first file, through Spark's own file access; no more of it is read."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(first)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        return bytes(stream.readNBytes(PREFIX))
    finally:
        stream.close()


def read_delimited(spark: SparkSession, path: str, given: Format | None = None) -> DataFrame:
    """All columns as text, named by the header. What stands before the header is left out by its place in the file, without a sort."""
    data = prefix_of(spark, path)
    form = given or detect(data)
    options = {"sep": form.delimiter, "encoding": "UTF-16" if form.encoding == "utf-16" else {"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}.get(form.encoding, "UTF-8"), "quote": '"', "escape": '"', "multiLine": "true"}
    if not form.skip:
        return spark.read.options(**options, header="true").csv(path)
    records = csv.reader(io.StringIO(data.decode(form.encoding, "replace")), delimiter=form.delimiter)
    before = sum(1 for _, r in zip(range(form.skip), records, strict=False) if r)  # Spark's reader passes over blank lines
    schema = ", ".join(f"`{h}` string" for h in next(records))
    # A file read in records that may span lines is one partition, whose rows are numbered in order.
    rows = spark.read.options(**options, header="false").schema(schema).csv(path).withColumn("at", F.monotonically_increasing_id())
    return rows.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) > before).drop("at")
