"""Lean of text on pages of one row against the operators on one row per pixel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import checks
from folio.operators import lean as LN
from folio.operators import projection as PR
from folio.operators import resample as RS
from folio.operators import scanlines as SL
from folio.plans import analyze as A
from folio.sources import tables as T


@pytest.fixture(scope="module")
def pages(spark):
    """Leaning, upright, empty, flat, too long and bordered pages beside noise."""
    from test_raster import text_page
    rng = np.random.default_rng(5)
    framed = np.zeros((600, 480), np.uint8)
    framed[40:560, 40:440] = text_page(0.0)
    shapes = [text_page(1.5), text_page(0.0), text_page(-3.5), np.full((90, 80), 200), rng.integers(0, 256, (130, 70)), np.tile(text_page(2.0), (3, 1)), framed, text_page(1.0).T]
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.astype(np.uint8).tobytes())) for i, p in enumerate(shapes)] + [(90, 64, 0, bytearray()), (91, None, None, None)]
    return spark.createDataFrame(rows, "image_id long, w int, h int, vals binary").repartition(4, "image_id").localCheckpoint()


def rows(d, *cols):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in d.collect())


def test_scores_of_both_forms_are_equal(pages):
    pts = PR.with_angles(PR.skew_points(SL.pixels(pages)), F.lit(-15.0), 0.5, 61)
    assert rows(LN.projection_scores(pages), "image_id", "angle", "score") == rows(PR.scores(pts, ["image_id"], PR._page_bin()), "image_id", "angle", "score")
    assert rows(LN.ink_by_angle(pages), "image_id", "angle", "points") == rows(pts.groupBy("image_id", "angle").agg(F.count(F.lit(1)).alias("points")), "image_id", "angle", "points")


def test_skew_of_both_forms_is_equal(pages):
    for dpi in (100, 200):
        want = PR.detect_skew(pages.select("image_id"), SL.pixels(pages), dpi)
        assert rows(LN.page_skew(pages, dpi), "image_id", "skew") == rows(want, "image_id", "skew")


@pytest.mark.parametrize("edge", [1200, 500])
def test_bands_of_both_forms_are_equal(pages, edge):
    cols = ["image_id", "dir", "band", "angle", "contrast", "n", "v"]
    got = rows(LN.band_angles(pages, edge), *cols)
    assert got == rows(PR.band_angles(PR.band_points(SL.pixels(pages), edge)), *cols) and len(got) > 8


def test_levelled_rows_of_both_forms_are_equal(spark, pages):
    t = spark.createDataFrame([(0, 1.5, 0.4), (4, -2.0, 0.0)], "image_id long, angle double, slope double")
    d = t.join(pages.select("image_id", "w", "h"), "image_id")
    cols = ["image_id", "y", "x", "v"]
    assert rows(SL.pixels(LN.level_rows(pages, t)), *cols) == rows(RS.level_rows(SL.pixels(pages), d), *cols)


def test_analysis_of_both_forms_is_equal(pages):
    some = pages.filter("h > 0")
    cols = ["image_id", "is_blank", "crop", "skew", "summary"]
    assert rows(A.analyze_page_rows(some), *cols) == rows(A.analyze_pages(some.select("image_id", "w", "h"), SL.pixels(some)), *cols)


@pytest.mark.parametrize("name", ["agg_09_projection_score", "join_15_ink_by_angle", "agg_10_detect_skew", "agg_11_band_angles", "agg_12_line_tilt",
                                  "img_10_level_text", "img_01_analyze_pages", "join_13_truth", "fil_07_drop_blank"])
def test_no_row_per_pixel(spark, sf, name, monkeypatch):
    monkeypatch.setattr(T, "text_pixels", lambda *a: pytest.fail("a row per pixel"))
    d = checks.load()[0][name](spark, sf)
    assert "Generate posexplode(chars" not in d._jdf.queryExecution().executedPlan().toString()
