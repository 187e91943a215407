"""Reports from JSON, text, positioned items or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<str:string,transform:array<double>,width:double,height:double>"
SCHEMA = f"doc_id string, original_filename string, stored_path string, extraction_status string, extracted_text string, extraction_notes string, warnings array<string>, is_fully_spatial boolean, layout_pages array<struct<page:int,items:array<{ITEM}>>>"
STATUSES = ("success", "failed", "scanned_fallback")
#: Bytes of a file, and characters that a text layer has at least.
MOST_BYTES, LEAST_TEXT = 5 * 1024 * 1024, 50


def status(text: Column) -> Column:
    """failed without text, scanned_fallback if there is too little of it, else success."""
    return F.when(text.isNull(), "failed").when(F.length(F.trim(text)) < LEAST_TEXT, "scanned_fallback").otherwise("success")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) ingestion records; a record needs a text and a known status."""
    rows = spark.read.schema(SCHEMA).json(path)
    fine = F.coalesce(F.col("extracted_text").isNotNull() & F.col("extraction_status").isin(*STATUSES), F.lit(False))
    return rows.where(fine), rows.where(~fine)


def from_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), t.alias("extracted_text"), status(t).alias("extraction_status"))


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of files up to MOST_BYTES, for an extractor to run on."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where(F.col("length") <= MOST_BYTES)


def items(ingestion: DataFrame) -> DataFrame:
    """(doc_id, page, item_id, text, x, y, width, height) of the layout pages; empty strings are left out."""
    pages = ingestion.select("doc_id", F.explode("layout_pages").alias("p"))
    rows = pages.select("doc_id", F.col("p.page").alias("page"), F.posexplode("p.items").alias("i", "it"))
    return rows.where(F.length("it.str") > 0).select("doc_id", "page", F.concat(F.lit("p"), "page", F.lit("-i"), "i").alias("item_id"), F.col("it.str").alias("text"), F.get("it.transform", F.lit(4)).alias("x"), F.get("it.transform", F.lit(5)).alias("y"), F.coalesce("it.width", F.lit(0.0)).alias("width"), F.coalesce("it.height", F.lit(0.0)).alias("height"))
