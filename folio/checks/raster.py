"""Histograms, thresholds, windows and connected ink on whole rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.checks.base import query, view
from folio.functions import settings as S
from folio.operators import raster as R
from folio.operators import scanlines as SL
from folio.plans import analyze as A
from folio.sources import tables as T

DIGEST = ("count(*) AS n, CAST(sum(v) AS BIGINT) AS total, "
          "CAST(sum(CAST(v AS BIGINT) * ((y * 131 + x * 17) % 1009)) AS BIGINT) AS placed")

view("f1_hist", "SELECT image_id, v, count(*) AS n FROM f1 GROUP BY image_id, v", ("f1",))


def by(df, *cols):
    return df.groupBy("image_id").agg(*(cols or R.digest()))


@query("agg_01_histogram", "f1_hist", "SELECT image_id, v, n FROM f1_hist")
def _(spark, sf):
    return SL.histogram(T.text_pages(spark, sf))


OTSU = """
    SELECT image_id, coalesce(max(v) FILTER (WHERE rk = 1 AND between_var IS NOT NULL), 128) AS threshold
    FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY between_var DESC NULLS LAST, v) AS rk
          FROM (SELECT image_id, v, CASE WHEN total - wb > 0 THEN
                       CAST(wb AS DOUBLE) * CAST(total - wb AS DOUBLE) * (sb / wb - (sum_all - sb) / (total - wb))
                       * (sb / wb - (sum_all - sb) / (total - wb)) END AS between_var
                FROM (SELECT image_id, v, sum(n) OVER a AS wb, CAST(sum(v * n) OVER a AS DOUBLE) AS sb,
                             sum(n) OVER b AS total, CAST(sum(v * n) OVER b AS DOUBLE) AS sum_all
                      FROM {hist} WINDOW a AS (PARTITION BY image_id ORDER BY v), b AS (PARTITION BY image_id))))
    GROUP BY image_id"""


@query("agg_02_otsu", "f1_hist", OTSU.format(hist="f1_hist"))
def _(spark, sf):
    return R.otsu(SL.histogram(T.text_pages(spark, sf)))


@query("agg_03_percentile_level", "f1_hist", """
    SELECT image_id, coalesce(min(v) FILTER (WHERE acc >= floor(total * CAST(0.9 AS DOUBLE))), 255) AS level
    FROM (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS acc, sum(n) OVER (PARTITION BY image_id) AS total
          FROM f1_hist) GROUP BY image_id""")
def _(spark, sf):
    d = T.text_pages(spark, sf).filter("h > 0")
    return d.select("image_id", SL.of(SL.percentile_of, 0.90).alias("level"))


@query("agg_04_box_downscale", "f1", f"""
    SELECT image_id, {DIGEST} FROM (SELECT image_id, y // 3 AS y, x // 3 AS x, sum(v) // 9 AS v FROM f1
      WHERE y // 3 < h // 3 AND x // 3 < w // 3 GROUP BY image_id, y // 3, x // 3) GROUP BY image_id""")
def _(spark, sf):
    return SL.digest(SL.shrink(T.text_pages(spark, sf), 3))


view("blank_inner", """
    SELECT * FROM f1 WHERE x >= w // 20 AND x < w - w // 20 AND y >= h // 20 AND y < h - h // 20
      AND w - 2 * (w // 20) >= 8 AND h - 2 * (h // 20) >= 8""", ("f1",))
view("blank_ink", """
    SELECT i.image_id, i.y, i.x FROM blank_inner i JOIN (
      SELECT image_id, coalesce(min(v) FILTER (WHERE acc >= floor(total * CAST(0.9 AS DOUBLE))), 255) AS paper
      FROM (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS acc, sum(n) OVER (PARTITION BY image_id) AS total
            FROM (SELECT image_id, v, count(*) AS n FROM blank_inner GROUP BY image_id, v)) GROUP BY image_id) p USING (image_id)
    WHERE v <= least(paper - 50, CAST(floor(paper * CAST(0.7 AS DOUBLE)) AS INTEGER))""", ("blank_inner",))
view("blank_degree", """
    SELECT a.image_id, a.y, a.x, count(b.image_id) AS deg, min(b.y * 64 + b.x) AS one
    FROM blank_ink a LEFT JOIN blank_ink b ON b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1
      AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.y <> a.y OR b.x <> a.x) GROUP BY a.image_id, a.y, a.x""", ("blank_ink",))
view("ink_share", """
    SELECT i.image_id, CASE WHEN w - 2 * (w // 20) < 8 OR h - 2 * (h // 20) < 8 THEN CAST(100 AS DOUBLE)
      ELSE coalesce(ink, 0) * CAST(100 AS DOUBLE) / ((w - 2 * (w // 20)) * (h - 2 * (h // 20))) END AS ink_percent
    FROM f1_image i LEFT JOIN (SELECT a.image_id, count(*) AS ink FROM blank_degree a
        LEFT JOIN blank_degree b ON b.image_id = a.image_id AND b.y * 64 + b.x = a.one
        WHERE NOT (a.deg = 0 OR (a.deg = 1 AND b.deg = 1)) GROUP BY a.image_id) USING (image_id)""",
     ("f1_image", "blank_degree"))


@query("agg_05_ink_percent", "ink_share", "SELECT image_id, round(ink_percent, 6) AS ink_percent FROM ink_share")
def _(spark, sf):
    d = A.page_ink_percent(T.text_pages(spark, sf))
    return d.select("image_id", F.round("ink_percent", 6).alias("ink_percent"))


@query("agg_06_is_blank", "ink_share",
       "SELECT image_id, round(ink_percent, 6) AS ink_percent, ink_percent < CAST(0.03 AS DOUBLE) AS is_blank FROM ink_share")
def _(spark, sf):
    d = A.page_ink_percent(T.text_pages(spark, sf))
    return d.select("image_id", F.round("ink_percent", 6).alias("ink_percent"), A.is_blank(F.col("ink_percent")).alias("is_blank"))


@query("agg_07_color_kind", "f2_rgb", """
    SELECT image_id, total, colored, midtone, CASE WHEN colored * CAST(100 AS DOUBLE) / total >= 0.5 THEN 'Color'
      WHEN midtone * CAST(100 AS DOUBLE) / total >= 8 THEN 'Gray' ELSE 'Bitonal' END AS kind
    FROM (SELECT image_id, count(*) AS total, count(*) FILTER (WHERE c) AS colored,
                 count(*) FILTER (WHERE NOT c AND lum > 60 AND lum < 180) AS midtone
          FROM (SELECT image_id, greatest(r, g, b) - least(r, g, b) > 60 AND greatest(r, g, b) > 60 AS c,
                       (r * 299 + g * 587 + b * 114) // 1000 AS lum FROM f2_rgb
                WHERE x >= w // 50 AND x < w - w // 50 AND y >= h // 50 AND y < h - h // 50) GROUP BY image_id)""")
def _(spark, sf):
    return A.color_kind(T.rgb_pixels(spark, sf))


view("bound_dark", """
    SELECT image_id, w, h, y, x, v < greatest(40, paper // 2) AS dark FROM f1 JOIN (
      SELECT image_id, coalesce(min(v) FILTER (WHERE acc >= floor(total * CAST(0.9 AS DOUBLE))), 255) AS paper
      FROM (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS acc, sum(n) OVER (PARTITION BY image_id) AS total
            FROM f1_hist) GROUP BY image_id) USING (image_id)""", ("f1_hist",))
view("bound_rows", """
    SELECT image_id, w, h, coalesce(min(y) FILTER (WHERE NOT d AND y < h // 4), h // 4) AS t,
           coalesce(max(y + 1) FILTER (WHERE NOT d AND y >= h - h // 4), h - h // 4) AS b
    FROM (SELECT image_id, w, h, y, count(*) FILTER (WHERE dark) > w * CAST(0.6 AS DOUBLE) AS d
          FROM bound_dark GROUP BY image_id, w, h, y) GROUP BY image_id, w, h""", ("bound_dark",))
view("bounds", """
    SELECT image_id, CAST(CASE WHEN l > 0 THEN least(w - 1, l + 1) ELSE 0 END AS INTEGER) AS x0,
           CAST(CASE WHEN t > 0 THEN least(h - 1, t + 1) ELSE 0 END AS INTEGER) AS y0,
           CAST(CASE WHEN r = w THEN w ELSE greatest((CASE WHEN l > 0 THEN least(w - 1, l + 1) ELSE 0 END) + 1, r - 1) END AS INTEGER) AS x1,
           CAST(CASE WHEN b = h THEN h ELSE greatest((CASE WHEN t > 0 THEN least(h - 1, t + 1) ELSE 0 END) + 1, b - 1) END AS INTEGER) AS y1
    FROM (SELECT image_id, w, h, t, b, coalesce(min(x) FILTER (WHERE NOT d AND x < w // 4), w // 4) AS l,
                 coalesce(max(x + 1) FILTER (WHERE NOT d AND x >= w - w // 4), w - w // 4) AS r
          FROM (SELECT p.image_id, p.w, p.h, t, b, x, count(*) FILTER (WHERE dark) > (b - t) * CAST(0.6 AS DOUBLE) AS d
                FROM bound_dark p JOIN bound_rows q ON q.image_id = p.image_id AND p.y >= t AND p.y < b
                GROUP BY p.image_id, p.w, p.h, t, b, x) GROUP BY image_id, w, h, t, b)""", ("bound_rows",))


@query("agg_08_content_bounds", "bounds", "SELECT image_id, x0, y0, x1, y1 FROM bounds")
def _(spark, sf):
    return A.page_content_bounds(T.text_pages(spark, sf))


def inked(spark, sf, area: int):
    """``image_id, ink, specks`` of pages with ink at or under their own threshold."""
    pages = T.text_pages(spark, sf).filter("h > 0")
    d = pages.join(R.otsu(SL.histogram(pages)), "image_id")
    return d.select("image_id", SL.of(SL.ink_of, F.col("threshold"), area).alias("d")).select("image_id", "d.*").filter("ink > 0 OR specks > 0")


@query("agg_26_despeckle_count", "f1_hist", f"""
    , cut AS ({OTSU.format(hist='f1_hist')}),
    ink AS (SELECT f1.image_id, y, x FROM f1 JOIN cut USING (image_id) WHERE v <= threshold)
    SELECT image_id, count(*) AS ink, count(*) FILTER (WHERE near = 0) AS specks
    FROM (SELECT a.image_id, a.y, a.x, count(b.image_id) AS near FROM ink a LEFT JOIN ink b ON b.image_id = a.image_id
          AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.y <> a.y OR b.x <> a.x)
          GROUP BY a.image_id, a.y, a.x) GROUP BY image_id""")
def _(spark, sf):
    area = S.area_for(100)
    d = inked(spark, sf, area)
    # specks of one pixel at this resolution: the ink that was there before
    return d.select("image_id", (F.col("ink") + F.col("specks") * area).alias("ink"), "specks")


SPECK_AREA = 4
AROUND = "(SELECT dy * 100000 + dx AS d FROM (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) b(dx)) k"
view("ink0", f"""
    SELECT f1.image_id, image_id * 10000000000 + y * 100000 + x AS key, image_id * 10000000000 + y * 100000 + x AS label
    FROM f1 JOIN ({OTSU.format(hist='f1_hist')}) cut USING (image_id) WHERE v <= threshold""", ("f1_hist",))
for n in range(1, SPECK_AREA):  # pixels of a piece of so many pixels are that many steps apart at most
    view(f"ink{n}", f"SELECT a.image_id, a.key, min(b.label) AS label FROM ink{n - 1} a CROSS JOIN {AROUND} JOIN ink{n - 1} b ON b.key = a.key + k.d GROUP BY a.image_id, a.key", (f"ink{n - 1}",))
view("pieces", f"""
    SELECT image_id, label, count(*) AS size, bool_and(same) AS closed
    FROM (SELECT a.image_id, a.key, a.label, bool_and(b.label = a.label) AS same FROM ink{SPECK_AREA - 1} a CROSS JOIN {AROUND} JOIN ink{SPECK_AREA - 1} b ON b.key = a.key + k.d GROUP BY a.image_id, a.key, a.label)
    GROUP BY image_id, label""", (f"ink{SPECK_AREA - 1}",))


@query("img_06_despeckle", "pieces", f"""
    SELECT image_id, CAST(coalesce(sum(size) FILTER (WHERE NOT (closed AND size <= {SPECK_AREA})), 0) AS BIGINT) AS ink, count(*) FILTER (WHERE closed AND size <= {SPECK_AREA}) AS specks FROM pieces GROUP BY image_id""")
def _(spark, sf):
    """Ink left and pieces removed at 200 dpi (at most four pixels)."""
    return inked(spark, sf, SPECK_AREA)


# --- windows -----------------------------------------------------------------------

def stats_sql(win: int, table: str = "f1") -> str:
    h = win // 2
    return f"""
    SELECT image_id, w, h, y, x, v, CAST(s1 AS DOUBLE) / n AS mean,
           greatest(CAST(0 AS DOUBLE), CAST(s2 AS DOUBLE) / n - (CAST(s1 AS DOUBLE) / n) * (CAST(s1 AS DOUBLE) / n)) AS variance
    FROM (SELECT image_id, w, h, y, x, v, sum(s1) OVER c AS s1, sum(s2) OVER c AS s2, sum(n) OVER c AS n
          FROM (SELECT *, sum(v) OVER r AS s1, sum(v * v) OVER r AS s2, count(*) OVER r AS n FROM {table}
                WINDOW r AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING))
          WINDOW c AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING))"""


WINDOW = S.window_for(100)
view("f1_stats", stats_sql(WINDOW), ("f1",))


@query("win_01_local_stats", "f1_stats", """
    SELECT image_id, count(*) AS n, CAST(sum(CAST(floor(mean * 1000) AS BIGINT)) AS BIGINT) AS mean_k,
           CAST(sum(CAST(floor(sqrt(variance) * 1000) AS BIGINT)) AS BIGINT) AS dev_k FROM f1_stats GROUP BY image_id""")
def _(spark, sf):
    d = SL.local_stats(T.text_pages(spark, sf).filter("h > 0"), WINDOW)
    thousandths = lambda c, f: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(f(x) * 1000))
    return d.select("image_id", F.size("mean").cast("bigint").alias("n"), thousandths("mean", lambda x: x).alias("mean_k"), thousandths("variance", F.sqrt).alias("dev_k"))


@query("win_02_sauvola", "f1_stats", f"""
    SELECT image_id, {DIGEST} FROM (SELECT image_id, y, x, CASE WHEN v <= mean * (1 + CAST(0.34 AS DOUBLE) * (sqrt(variance) / 128 - 1))
      THEN 0 ELSE 255 END AS v FROM f1_stats) GROUP BY image_id""")
def _(spark, sf):
    return SL.digest(SL.sauvola(T.text_pages(spark, sf), WINDOW, S.SAUVOLA_K))


def window_pair(fn: str, r: int, table: str, div: bool = False) -> str:
    wrap = (lambda w: f"sum(v) OVER {w} // count(*) OVER {w}") if div else (lambda w: f"{fn}(v) OVER {w}")
    return f"""
    SELECT image_id, y, x, {wrap('c')} AS v FROM (SELECT image_id, w, h, y, x, {wrap('r')} AS v FROM {table}
        WINDOW r AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING))
    WINDOW c AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"""


@query("win_03_max_filter", "f2_mosaic", f"SELECT image_id, {DIGEST} FROM ({window_pair('max', 2, 'f2_mosaic')}) GROUP BY image_id")
def _(spark, sf):
    return by(R.max_filter(T.mosaic_pixels(spark, sf), 2))


@query("win_04_box_blur", "f2_mosaic", f"SELECT image_id, {DIGEST} FROM ({window_pair('sum', 3, 'f2_mosaic', True)}) GROUP BY image_id")
def _(spark, sf):
    return by(R.box_blur(T.mosaic_pixels(spark, sf), 3))


def padded_pass(axis: str, table: str, r: int, keep: str = "") -> str:
    """One replicated box pass by joining every pixel to its clamped neighbours."""
    n = 2 * r + 1
    size = "w" if axis == "x" else "h"
    other = "y" if axis == "x" else "x"
    return f"""
    SELECT a.image_id, a.w, a.h, a.y, a.x, {keep} CAST((sum(b.v) + {n // 2}) // {n} AS INTEGER) AS v
    FROM (SELECT *, unnest(range(-{r}, {r + 1})) AS k FROM {table}) a
    JOIN {table} b ON b.image_id = a.image_id AND b.{other} = a.{other} AND b.{axis} = least(greatest(a.{axis} + a.k, 0), a.{size} - 1)
    GROUP BY a.image_id, a.w, a.h, a.y, a.x"""


view("us1", padded_pass("x", "f2_mosaic", 2), ("f2_mosaic",))
view("us2", padded_pass("y", "us1", 2), ("us1",))
view("us3", padded_pass("x", "us2", 2), ("us2",))
view("us4", padded_pass("y", "us3", 2), ("us3",))
view("sharp", """
    SELECT m.image_id, m.w, m.h, m.y, m.x, CASE WHEN o <= 0 THEN 0 WHEN o >= 255 THEN 255
           ELSE CAST(floor(CAST(o + CAST(0.5 AS FLOAT) AS FLOAT)) AS INTEGER) END AS v
    FROM (SELECT f.image_id, f.w, f.h, f.y, f.x, CAST(CAST(f.v AS FLOAT) + CAST(CAST(0.8 AS FLOAT) * CAST(f.v - b.v AS FLOAT) AS FLOAT) AS FLOAT) AS o
          FROM f2_mosaic f JOIN us4 b USING (image_id, y, x)) m""", ("f2_mosaic", "us4"))


@query("win_05_unsharp", "sharp", f"SELECT image_id, {DIGEST} FROM sharp GROUP BY image_id")
def _(spark, sf):
    return by(R.unsharp(T.mosaic_pixels(spark, sf), 2, S.UNSHARP_AMOUNT))


# --- single-step functions on pixels -----------------------------------------------

@query("sca_27_settings", "f10", """
    SELECT page_id, greatest(1, dpi // 100) AS factor, least(greatest(CAST(round_even(dpi / CAST(8 AS DOUBLE), 0) AS INTEGER) | 1, 15), 151) AS win,
           round(CAST(0.55 AS DOUBLE) - CAST(0.0042 AS DOUBLE) * least(greatest(darkness, 0), 100), 6) AS k,
           CAST(round_even((least(greatest(darkness, 0), 100) - 50) * CAST(0.8 AS DOUBLE), 0) AS INTEGER) AS otsu_shift,
           least(greatest(CAST(round_even(dpi / CAST(150 AS DOUBLE), 0) AS INTEGER), 1), 4) AS radius,
           greatest(1, dpi // 100) * greatest(1, dpi // 100) AS speck
    FROM (SELECT page_id, darkness * 2 - 40 AS darkness, q * 25 AS dpi FROM f10)""")
def _(spark, sf):
    p = T.pages(spark, sf).select("page_id", (F.col("darkness") * 2 - 40).alias("darkness"), (F.col("q") * 25).alias("dpi"))
    d = F.col("dpi")
    return p.select("page_id", S.analysis_factor(d).alias("factor"), S.sauvola_window(d).alias("win"),
                    F.round(S.sauvola_k(F.col("darkness")), 6).alias("k"), S.otsu_offset(F.col("darkness")).alias("otsu_shift"),
                    S.sharpen_radius(d).alias("radius"), S.speckle_area(d).alias("speck"))


@query("sca_29_shade", "f2", """
    SELECT image_id, y, x, CASE WHEN v <= t THEN 0 ELSE 255 END AS hard,
           CASE WHEN o <= 0 THEN 0 WHEN o >= 255 THEN 255 ELSE CAST(floor(o) AS INTEGER) END AS soft
    FROM (SELECT *, CAST(127.5 AS DOUBLE) + (v - t) * CAST(10.625 AS DOUBLE) AS o FROM (SELECT *, CAST(120 + x AS DOUBLE) + CAST(0.5 AS DOUBLE) AS t FROM f2))""")
def _(spark, sf):
    t = F.lit(120.5) + F.col("x")
    return T.tile_pixels(spark, sf).select("image_id", "y", "x", R.shade(F.col("v"), t).alias("hard"),
                                           R.shade(F.col("v"), t, S.SMOOTH_RAMP).alias("soft"))


@query("sca_43_luma", "f2_rgb", """
    SELECT image_id, y, x, (r * 299 + g * 587 + b * 114 + 500) // 1000 AS luma, (r * 299 + g * 587 + b * 114) // 1000 AS luma_classify,
           (r * 77 + g * 150 + b * 29) >> 8 AS luma_sig FROM f2_rgb""")
def _(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return T.rgb_pixels(spark, sf).select("image_id", "y", "x", S.luma(r, g, b).alias("luma"),
                                          S.luma_classify(r, g, b).alias("luma_classify"), S.luma_signature(r, g, b).alias("luma_sig"))


@query("sca_45_gray_turn", "f2", """
    SELECT turns, image_id, x, y, v FROM (
      SELECT 1 AS turns, image_id, h - 1 - y AS x, x AS y, v FROM f2 UNION ALL SELECT 2, image_id, w - 1 - x, h - 1 - y, v FROM f2
      UNION ALL SELECT 3, image_id, y, w - 1 - x, v FROM f2)""")
def _(spark, sf):
    px = T.tile_pixels(spark, sf)
    parts = [R.quarter_turn(px, t).select(F.lit(t).alias("turns"), "image_id", "x", "y", "v") for t in (1, 2, 3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("sca_46_crop_halves", "f1", """
    SELECT image_id, half, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(CAST(v AS BIGINT) * ((y * 131 + x * 17) % 1009)) AS BIGINT) AS placed,
           count(*) FILTER (WHERE v <= 127) AS ink FROM (
      SELECT image_id, 'left' AS half, y, x, v FROM f1 WHERE x < 37 UNION ALL SELECT image_id, 'right', y, x - 26, v FROM f1 WHERE x >= 26
      UNION ALL SELECT image_id, 'crop', y - h // 4, x - 8, v FROM f1 WHERE x >= 8 AND x < 56 AND y >= h // 4 AND y < h - h // 4)
    GROUP BY image_id, half""")
def _(spark, sf):
    px = T.text_pixels(spark, sf)
    q = F.floor(F.col("h") / 4)
    inner = R.crop(px, F.lit(8), q, F.lit(56), F.col("h") - q).withColumn("half", F.lit("crop"))
    d = R.book_halves(px).select("image_id", "half", "y", "x", "v").unionAll(inner.select("image_id", "half", "y", "x", "v"))
    return d.groupBy("image_id", "half").agg(*R.digest(), F.count_if(F.col("v") <= 127).alias("ink"))


view("f2_hist", "SELECT image_id, v, count(*) AS n FROM f2 GROUP BY image_id, v", ("f2",))
