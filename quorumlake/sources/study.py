"""Study folders: clinical tables with a commented header, mutations, a copy-number matrix, panels and case lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.cells import typed_column
from quorumlake.operators.infer import unpivoted
from quorumlake.sources.delimited import Format, prefix_of

#: Types that the second header line names, and what a copy-number call stands for.
CLINICAL = {"STRING": "category", "NUMBER": "number", "BOOLEAN": "boolean"}
CALLS = {"-2": "deep_deletion", "-1.5": "deep_deletion", "-1": "shallow_deletion", "0": "diploid", "1": "gain", "2": "amplification"}


def tab_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table after its lines of comment."""
    text = prefix_of(spark, path).decode("utf-8", "replace").splitlines()
    header = next(line for line in text if not line.startswith("#")).split("\t")
    schema = ", ".join(f"`{h}` string" for h in header)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "\t".join(header)) & (F.length("value") > 0))
    return lines.select(F.from_csv("value", F.lit(schema), {"sep": "\t", "quote": ""}).alias("r")).select("r.*")


def clinical(spark: SparkSession, path: str) -> DataFrame:
    """A clinical table, typed as its comment lines say: names, descriptions, types, priorities."""
    notes = [line[1:].split("\t") for line in prefix_of(spark, path).decode("utf-8", "replace").splitlines() if line.startswith("#")]
    frame = tab_table(spark, path)
    for name, kind in zip(frame.columns, notes[2] if len(notes) > 2 else [], strict=False):
        if CLINICAL.get(kind.strip()) in ("number", "boolean"):
            frame = typed_column(frame, name, CLINICAL[kind.strip()], {"NA": "UNKNOWN", "[Not Available]": "UNKNOWN", "[Not Applicable]": "NOT_APPLICABLE"})
    return frame


def copy_numbers(spark: SparkSession, path: str, gene: str = "Hugo_Symbol") -> DataFrame:
    """(gene, sample, alteration) of a gene by sample matrix; cells without a call are left out."""
    matrix = tab_table(spark, path)
    keys = [c for c in (gene, "Entrez_Gene_Id", "Cytoband") if c in matrix.columns]
    calls = unpivoted(matrix.drop(*[k for k in keys if k != gene]), [gene], "sample", "call")
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in CALLS.items() for x in kv]), F.trim("call"))
    return calls.select(F.col(gene).alias("gene"), "sample", named.alias("alteration"))


def case_list(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, sample) of a case list file."""
    fields = spark.read.text(path).select(F.split("value", ": ", 2).alias("kv")).select(F.col("kv")[0].alias("k"), F.col("kv")[1].alias("v"))
    row = fields.agg(F.max(F.when(F.col("k") == "stable_id", F.col("v"))).alias("list_id"), F.max(F.when(F.col("k") == "case_list_ids", F.col("v"))).alias("ids"))
    return row.select("list_id", F.explode(F.split("ids", "\t")).alias("sample"))


def read_study(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a study folder, those that are there."""
    have = {r["path"].rsplit("/", 1)[-1]: r["path"] for r in spark.read.format("binaryFile").load(folder).select("path").collect()}
    out: dict[str, DataFrame] = {}
    for name, file in (("patients", "data_clinical_patient.txt"), ("samples", "data_clinical_sample.txt")):
        if file in have:
            out[name] = clinical(spark, have[file])
    for name, file in (("mutations", "data_mutations.txt"), ("structural_variants", "data_sv.txt"), ("gene_panel_matrix", "data_gene_panel_matrix.txt")):
        if file in have:
            out[name] = tab_table(spark, have[file])
    if "data_cna.txt" in have:
        out["cna_calls"] = copy_numbers(spark, have["data_cna.txt"])
    return out


__all__ = ["Format", "case_list", "clinical", "copy_numbers", "read_study", "tab_table"]
