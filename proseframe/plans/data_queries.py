"""Queries of the general data problems: nested records and units."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, units
from ..operators.lineage import shared_folder
from ..sources import docx
from .base import RUNS, runs


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.runs_of_records(_read(spark, sf, "docx_records"))


def p2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nested_nodes(_read(spark, sf, "docx_records"))


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    """Each figure with the text of its run. Runs are joined by key only where a figure points to them."""
    f = _read(spark, sf, "figures").select("figure_id", "series_id", "doc_id", "para_idx", "run_idx", "unit_note").dropDuplicates(["figure_id"])
    r = _read(spark, sf, "runs").where("text IS NOT NULL").select("doc_id", "para_idx", "run_idx", "text")
    joined = f.join(r, ["doc_id", "para_idx", "run_idx"]).dropDuplicates(["figure_id"])
    return units.with_quantities(joined, units.conversion_table(spark, _read(spark, sf, "fx")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.agreeing_pairs(_stated(spark, sf), "figure_id", "series_id").select(F.col("a").alias("figure_a"), F.col("b").alias("figure_b"))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    return _stated(spark, sf).select("figure_id", "series_id", "quantity_kind", "stated_number", "stated_unit", "canonical_unit", "value")


def p4_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Each figure with the numbers of figures of its series that state the same value, and that agree with it otherwise."""
    return units.agreement(_stated(spark, sf), "figure_id", "series_id")


def docx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as a Word file and read again, in memory, one document at a time: its runs, characters and references."""
    r = runs(spark, sf, "text", "bold", "italic", "kind")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["para_idx", "run_idx"])
        doc = pdf["doc_id"].iloc[0]
        paras = [(None, [{"text": t, "bold": b is True, "italic": i is True, "note_ref": "1" if k == "footnote_ref" else None} for t, b, i, k in zip(g["text"], g["bold"].astype(object), g["italic"].astype(object), g["kind"])]) for _, g in pdf.groupby("para_idx", sort=True)]
        back = list(docx.read_rows(doc, docx.container({"word/document.xml": docx.document_xml(paras).encode()}), "runs"))
        return pd.DataFrame({"doc_id": [doc], "runs": [len(back)], "chars": [sum(len(x[3] or "") for x in back)], "refs": [sum(x[7] == "footnote_ref" for x in back)], "bold": [sum(x[4] is True for x in back)]})

    return r.groupBy("doc_id").applyInPandas(one, "doc_id string, runs long, chars long, refs long, bold long")


def docx_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as a Word file into the shared folder and read through the data source: its runs, characters and references."""
    folder = f"{shared_folder(spark)}/docx-{uuid.uuid4().hex}"
    r = runs(spark, sf, "text", "bold", "italic", "kind")
    r = r.withColumn("note_ref", F.when(F.col("kind") == "footnote_ref", F.lit("1"))).withColumn("style", F.lit(None).cast("string"))
    docx.write_documents(r, folder)
    docx.register(spark)
    back = spark.read.format("docx").option("part", "runs").option("path", folder).load()
    c = lambda x: F.count(F.when(x, 1))
    return back.groupBy("doc_id").agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), c(F.col("kind") == "footnote_ref").alias("refs"), c(F.col("bold")).alias("bold"))


QUERIES = {f.__name__: f for f in (docx_roundtrip, docx_files, p2_found, p2_nodes, p4_found, p4_values, p4_agreement)}
_FILES = f"SELECT doc_id, count(*) AS runs, CAST(sum(CASE WHEN kind = 'footnote_ref' THEN 0 ELSE length(coalesce(text, '')) END) AS BIGINT) AS chars, count(*) FILTER (kind = 'footnote_ref') AS refs, count(*) FILTER (coalesce(bold, false)) AS bold FROM {RUNS} GROUP BY doc_id"
ORACLE: dict[str, str] = {"docx_roundtrip": _FILES, "docx_files": _FILES}
