"""From ready pages to rows that describe the exported documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import layout as L
from folio.functions import naming as N
from folio.functions import pages as P
from folio.operators import catalogue as C
from folio.operators.ordered import block


def export_plan(pages: DataFrame, pattern: str, ts, mode: str = "barcode", prefix: str = "", keep_separators: bool = False, taken: DataFrame | None = None) -> DataFrame:
    """``batch_id, doc_no, page_id, file_name, codec`` and the sheet layout of every exported page.

    ``pages``: ``batch_id, pos, page_id, state, is_blank, barcode, w, h, free, kind, is_raw_jpeg``.
    Pages that are not ready are left out; documents are split, named, made unique against
    each other and names already there.
    """
    ready = pages.filter("state = 'Ready'")
    split = C.document_groups(ready, mode, prefix, keep_separators)
    docs = C.batch_counter(split)
    named = docs.withColumn("name", N.build_name(pattern, ts, F.col("counter"), F.col("doc_barcode")))
    named = C.unique_names(named, taken, block("batch_id"), ["batch_id", "doc_no"])
    d = split.join(named.select("batch_id", "doc_no", "unique_name"), ["batch_id", "doc_no"])
    codec = P.export_codec(F.col("kind"), F.col("is_raw_jpeg"), F.lit(True))
    sheet = L.page_layout(F.col("w"), F.col("h"), F.col("free"))
    return d.select("batch_id", "doc_no", "pos", "page_id", F.concat("unique_name", F.lit(".pdf")).alias("file_name"), codec.alias("codec"),
                    *[c.alias(n) for n, c in sheet.items()])
