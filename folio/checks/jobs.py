"""Whole jobs: page analysis, render plans, export plans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folio.checks import base
from folio.checks.base import query, view
from folio.checks.geometry import K, KEYS
from folio.plans import analyze as A
from folio.plans import export as X
from folio.plans import render as RN
from folio.checks.raster import by
from folio.sources import tables as T

Q = F.col

# the lean views again, on pages cropped to their content and not blank
view("c1", """
    SELECT f1.image_id, CAST(x1 - x0 AS INTEGER) AS w, CAST(y1 - y0 AS INTEGER) AS h, CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, v FROM f1 JOIN bounds USING (image_id)
    JOIN ink_share s ON s.image_id = f1.image_id AND NOT (ink_percent < CAST(0.03 AS DOUBLE)) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""", ("f1", "bounds", "ink_share"))
view("c1_hist", "SELECT image_id, v, count(*) AS n FROM c1 GROUP BY image_id, v", ("c1",))


def _on_cropped(text: str) -> str:
    return re.sub(r"\bskew_", "cskew_", re.sub(r"\bf1(_hist)?\b", r"c1\1", text))


def _cropped_views():
    import folio.checks.looks  # noqa: F401  (defines the views on whole pages)
    for n in ("skew_ink", "skew_coarse", "skew_best", "skew_fine"):
        needs, sql = base.VIEWS[n]
        view(_on_cropped(n), _on_cropped(sql), tuple(_on_cropped(d) for d in needs))


_cropped_views()


@query("img_01_analyze_pages", "f1_image ink_share bounds cskew_best cskew_fine", """
    SELECT i.image_id, blank AS is_blank, CASE WHEN cut THEN round(x0 / CAST(w AS DOUBLE), 6) END AS crop_x, CASE WHEN cut THEN round(y0 / CAST(h AS DOUBLE), 6) END AS crop_y,
           CASE WHEN cut THEN round((x1 - x0) / CAST(w AS DOUBLE), 6) END AS crop_w, CASE WHEN cut THEN round((y1 - y0) / CAST(h AS DOUBLE), 6) END AS crop_h,
           round(CASE WHEN s >= zero * CAST(1.05 AS DOUBLE) AND abs(ang) >= 0.1 THEN ang ELSE 0 END, 6) AS skew
    FROM (SELECT f.image_id, w, h, x0, y0, x1, y1, ink_percent < CAST(0.03 AS DOUBLE) AS blank, NOT (ink_percent < CAST(0.03 AS DOUBLE)) AND (x1 - x0 < w OR y1 - y0 < h) AS cut
          FROM f1_image f JOIN ink_share USING (image_id) LEFT JOIN bounds USING (image_id)) i
    LEFT JOIN (SELECT b.image_id, zero, CASE WHEN fs > bs THEN fa ELSE best END AS ang, greatest(fs, bs) AS s FROM cskew_best b
      JOIN (SELECT image_id, arg_max(a, (score, -a)) AS fa, max(score) AS fs FROM cskew_fine GROUP BY image_id) f USING (image_id)) z USING (image_id)""")
def _(spark, sf):
    d = A.analyze_page_rows(T.text_pages(spark, sf))
    return d.select("image_id", "is_blank", *[F.round(f"crop.{c}", 6).alias(f"crop_{c}") for c in "xywh"], F.round("skew", 6).alias("skew"))


@query("img_11_render_plan", "f7_plan", f"""
    SELECT {K}, rx0 AS region_x, ry0 AS region_y, rw AS region_w, rh AS region_h, sample, out_w, out_h, greatest(50, CAST(round_even(greatest(out_w, out_h) / CAST(11.69 AS DOUBLE), 0) AS INTEGER)) AS dpi, CAST(q AS INTEGER) + 1 AS revision
    FROM f7_plan WHERE q % 3 <> 0""")
def _(spark, sf):
    c = T.quad_cases(spark, sf).withColumn("revision", Q("q").cast("int"))
    d = RN.render_plan(c, Q("q") % 3 != 0)
    return d.select(*KEYS, "region_x", "region_y", "region_w", "region_h", "sample", "out_w", "out_h", "dpi", "revision")


@query("img_11_render_pages")
def _(spark, sf):
    """Warp, turn and even lighting of every picture; the single steps have their own checks."""
    px = T.mosaic_pixels(spark, sf)
    quad = F.array(*[F.lit(v) for v in (4.0, 3.0, 60.0, 5.0, 62.0, 61.0, 2.0, 59.0)])
    plan = px.select("image_id", "w", "h").distinct().withColumns({"quad": quad, "out_w": F.lit(48), "out_h": F.lit(56), "turns": Q("image_id") % 4})
    return by(RN.render_pages(px, plan, "Gray"))


view("f12_pages", """
    SELECT *, CASE WHEN size % 11 = 0 THEN 'Failed' ELSE 'Ready' END AS state, 600 + size % 500 AS w, 800 + size % 300 AS h, size % 4 = 0 AS free,
           CASE size % 3 WHEN 0 THEN 'Bitonal' WHEN 1 THEN 'Gray' ELSE 'Color' END AS color, size % 2 = 0 AS raw, barcode IS NOT NULL AND starts_with(lower(barcode), 'sep-a') AS sep FROM f3""", ("f3",))
view("f12_docs", """
    SELECT *, dense_rank() OVER (PARTITION BY batch_id ORDER BY g) AS doc_no FROM (SELECT *, max(CASE WHEN sep THEN barcode END) OVER (PARTITION BY batch_id, g) AS code FROM (
      SELECT *, count(*) FILTER (WHERE sep) OVER (PARTITION BY batch_id ORDER BY pos) AS g FROM f12_pages WHERE state = 'Ready')) WHERE NOT sep""", ("f12_pages",))


@query("img_12_export_plan", "f12_docs", """
    , nm AS (SELECT batch_id, doc_no, name, row_number() OVER (PARTITION BY name ORDER BY batch_id, doc_no) AS k FROM (
        SELECT DISTINCT batch_id, doc_no, 'Scan_20260925_' || coalesce(code, '') || '_' || lpad(CAST(doc_no AS VARCHAR), 3, '0') AS name FROM f12_docs))
    SELECT d.batch_id, d.doc_no, d.page_id, name || CASE WHEN k = 1 THEN '' ELSE '_' || k END || '.pdf' AS file_name, CASE WHEN color = 'Bitonal' THEN 'bitonal' WHEN raw THEN 'original' WHEN color = 'Gray' THEN 'gray-jpeg' ELSE 'color-jpeg' END AS codec,
           round(CASE WHEN free THEN w * (841.89::DOUBLE / greatest(w, h)) WHEN w > h THEN 841.89 ELSE 595.276 END, 6) AS sheet_w, round(CASE WHEN free THEN h * (841.89::DOUBLE / greatest(w, h)) WHEN w > h THEN 595.276 ELSE 841.89 END, 6) AS sheet_h
    FROM f12_docs d JOIN nm ON nm.batch_id = d.batch_id AND nm.doc_no = d.doc_no""")
def _(spark, sf):
    p = T.batch_pages(spark, sf)
    n = Q("size")
    p = p.withColumns({"state": F.when(n % 11 == 0, "Failed").otherwise("Ready"), "w": 600 + n % 500, "h": 800 + n % 300, "free": n % 4 == 0,
                       "kind": F.when(n % 3 == 0, "Bitonal").when(n % 3 == 1, "Gray").otherwise("Color"), "is_raw_jpeg": n % 2 == 0})
    d = X.export_plan(p, "Scan_{date}_{barcode}_{counter}", F.timestamp_seconds(F.lit(1790316000)), "barcode", "SEP-a")
    return d.select("batch_id", "doc_no", "page_id", "file_name", "codec", F.round("sheet_w", 6).alias("sheet_w"), F.round("sheet_h", 6).alias("sheet_h"))
