"""Counters of imports, ingests, folders and exports: partial aggregates that combine before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURES_SHOWN = 8  # fixed value: how many failed items a status line names; ``failures`` has all


def ingest_summary(pages: DataFrame, key: str) -> DataFrame:
    failed = F.col("state") == "Failed"
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_blank") & ~failed).alias("blank"), F.count_if(failed).alias("failed"))


def import_status(pages: DataFrame) -> DataFrame:
    """Progress per document; finished ones without failures report nothing. Lists the first failures.

    The list is cut by rank before it is collected (Spark keeps only the first few per task), so
    its size never follows the number of failures.
    """
    waiting, failed = F.col("state") == "Importing", F.col("state") == "Failed"
    counts = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~waiting).alias("done"), F.count_if(waiting).alias("remaining"),
        (F.count_if(waiting) > 0).alias("running"), F.count_if(failed).alias("failures")).filter("remaining > 0 OR failures > 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id"))
    first = pages.filter(failed).select("doc_id", "page_id").withColumn("_r", rank).filter(F.col("_r") <= FAILURES_SHOWN)
    shown = first.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("page_id")), ",").alias("shown"))
    return counts.join(shown, "doc_id", "left").withColumn("shown", F.coalesce("shown", F.lit("")))


def failures(pages: DataFrame) -> DataFrame:
    """``doc_id, page_id, nth``: every failed page, numbered within its document."""
    bad = pages.filter(F.col("state") == "Failed").select("doc_id", "page_id")
    return bad.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id")))


def folder_counts(folders: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``folder_id, docs, pages, busy``; busy pages are still being prepared."""
    per_doc = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("state").isin("Pending", "Preview")).alias("_b"))
    per_folder = docs.join(per_doc, "doc_id", "left").groupBy(F.col("folder_id").alias("_f")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("_n").alias("pages"), F.sum("_b").alias("busy"))
    d = folders.join(per_folder, F.col("folder_id") == F.col("_f"), "left")
    return d.select("folder_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "pages", "busy")])


def export_totals(files: DataFrame) -> DataFrame:
    """Finished exports and their bytes, and the bytes of everything stored."""
    done = F.lower("path").endswith(".pdf")
    return files.agg(F.count_if(done).alias("files"), F.sum(F.when(done, F.col("length"))).alias("bytes"), F.sum("length").alias("storage"))
