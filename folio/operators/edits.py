"""Edits from a log applied to page tables: crops, turns of the finished page, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.stamps import stamp_rotate


def set_crop(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Last outline set by hand: bends are cleared and automatic detection is locked out."""
    last = edits.groupBy("page_id").agg(F.max_by("new_quad", F.struct("ts", "seq")).alias("_q"))
    d = pages.join(last, "page_id", "left")
    hit = F.col("_q").isNotNull()
    return d.withColumns({"quad": F.coalesce("_q", "quad"), "bend": F.when(~hit, F.col("bend")),
                          "manual": F.col("manual") | hit}).drop("_q")


def rotate_output(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns of the finished page added up; its stamps turn along; the last shape choice wins."""
    e = edits.groupBy("page_id").agg(F.pmod(F.sum((F.col("degrees") / 90).cast("int")), F.lit(4)).alias("_t"),
                                     F.max_by("new_free", F.struct("ts", "seq")).alias("_f"))
    d = pages.join(e, "page_id", "left").withColumn("_t", F.coalesce("_t", F.lit(0)))

    def turned(s):
        x, y, t = stamp_rotate(s["cx"], s["cy"], s["turns"], F.col("_t"))
        return s.withField("cx", x).withField("cy", y).withField("turns", t)

    stamps = F.transform("stamps", turned)
    return d.withColumns({"turn": ((F.col("turn") + F.col("_t") * 90) % 360).cast("int"), "free": F.coalesce("_f", "free"),
                          "stamps": F.when(F.size(stamps) > 0, stamps)}).drop("_t", "_f")


def delete_documents(pages: DataFrame, gone: DataFrame) -> DataFrame:
    return pages.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def trash_pages(pages: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Pages with ``place``: trashed ones keep their old position for a later restore."""
    g = gone.select(F.col(key).alias("_g")).distinct()
    return pages.join(g, F.col(key) == F.col("_g"), "left").withColumn(
        "place", F.when(F.col("_g").isNotNull(), "trash").otherwise("kept")).drop("_g")
