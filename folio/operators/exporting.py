"""Which pages of a document can be exported, and which are reported as skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exportable(state: Column, needs_render: Column, revision: Column) -> Column:
    return (state == "Ready") & ~needs_render & (revision > 0)


def _ok() -> Column:
    return exportable(F.col("state"), F.col("needs_render"), F.col("revision"))


def exportable_summary(pages: DataFrame) -> DataFrame:
    """``doc_id, ready, desktop_ready, skipped``: counts per document."""
    return pages.groupBy("doc_id").agg(F.count_if(_ok()).alias("ready"), F.count_if(F.col("state") == "Ready").alias("desktop_ready"),
                                       F.count_if(~_ok()).alias("skipped"))


def skipped_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, pos``: the page numbers an export leaves out, as rows (a document may be any size)."""
    return pages.filter(~_ok()).select("doc_id", "pos")


def export_result(pages: DataFrame) -> DataFrame:
    """``doc_id, pages, skipped, bytes`` of each export."""
    return pages.groupBy("doc_id").agg(F.count_if(_ok()).alias("pages"), F.count_if(~_ok()).alias("skipped"),
                                       F.coalesce(F.sum(F.when(_ok(), F.col("bytes"))), F.lit(0)).alias("bytes"))
