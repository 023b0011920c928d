"""Pixel operators against small numpy references."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def pixels(spark, images: dict[int, np.ndarray]):
    rows = [(k, a.shape[1], a.shape[0], y, x, int(a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, w int, h int, y int, x int, v int").repartition(4, "image_id")


def back(df, shape, v="v"):
    a = np.full(shape, -1)
    for r in df.collect():
        a[r.y, r.x] = r[v]
    return a


def flood(ink: np.ndarray):
    """Label 8-connected pieces; returns the list of pieces as pixel lists."""
    seen, out = set(), []
    for p in zip(*np.nonzero(ink)):
        if p in seen:
            continue
        piece, stack = [], [p]
        seen.add(p)
        while stack:
            y, x = stack.pop()
            piece.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < ink.shape[0] and 0 <= q[1] < ink.shape[1] and ink[q] and q not in seen:
                        seen.add(q)
                        stack.append(q)
        out.append(piece)
    return out


@pytest.mark.parametrize("area", [1, 2, 4, 6])
def test_small_components_equal_flood_fill(spark, area):
    from folio.operators import raster as R
    rng = np.random.default_rng(area)
    images = {k: (rng.random((23, 37)) > 0.8).astype(int) for k in range(3)}
    px = pixels(spark, {k: 1 - a for k, a in images.items()}).filter("v = 0")
    got = {(r.image_id, r.y, r.x) for r in R.small_components(px, area).collect()}
    want = {(k, y, x) for k, a in images.items() for piece in flood(a) if len(piece) <= area for y, x in piece}
    assert got == want
    counts = {r.image_id: (r.ink, r.specks) for r in R.ink_after_specks(px, area).collect()}
    for k, a in images.items():
        pieces = flood(a)
        assert counts[k] == (sum(len(p) for p in pieces if len(p) > area), sum(len(p) <= area for p in pieces))


def test_sauvola_and_stats(spark):
    from folio.operators import raster as R
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (31, 22))
    s = {(r.y, r.x): (r.mean, r.variance) for r in R.local_stats(pixels(spark, {0: a}), 15).collect()}
    for (y, x), (m, v) in s.items():
        w = a[max(0, y - 7):y + 8, max(0, x - 7):x + 8].astype(float)
        assert math.isclose(m, w.mean(), abs_tol=1e-9) and math.isclose(v, max(0, (w * w).mean() - w.mean() ** 2), abs_tol=1e-6)


def test_turns_commute_with_stats(spark):
    from folio.operators import raster as R
    a = np.random.default_rng(2).integers(0, 256, (17, 12))
    px = pixels(spark, {0: a})
    one = R.quarter_turn(R.local_stats(px, 15), 1).select("y", "x", F.round("mean", 9).alias("m"))
    two = R.local_stats(R.quarter_turn(px, 1), 15).select("y", "x", F.round("mean", 9).alias("m"))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    four = px
    for _ in range(4):
        four = R.quarter_turn(four, 1)
    assert four.exceptAll(px).count() == 0


def test_bimodal_otsu(spark):
    from folio.operators import raster as R
    h = spark.createDataFrame([(1, 40, 1000), (1, 200, 9000), (2, 77, 5)], "image_id long, v int, n long")
    got = {r.image_id: r.threshold for r in R.otsu(h).collect()}
    assert 40 <= got[1] < 200 and got[2] == 128


def text_page(skew: float, w=400, h=520):
    a = np.full((h, w), 255)
    for line in range(20):
        for k in range(26):
            if k % 5 == 4:
                continue
            for i in range(9):
                x = 20 + k * 14 + i
                y = 40 + line * 22 + round((x - w / 2) * math.tan(math.radians(skew)))
                if 0 <= y < h - 4 and x < w:
                    a[y:y + 4, x] = 30
    return a


@pytest.mark.parametrize("skew", [0.0, 2.0, -3.5])
def test_detect_skew(spark, skew):
    from folio.operators import projection as P
    px = pixels(spark, {0: text_page(skew)})
    got = P.detect_skew(px.select("image_id", "w", "h").distinct(), px).first().skew
    assert abs(got - skew) <= 0.15


def test_line_tilt_is_measured_and_levelled(spark):
    from folio.operators import projection as P
    from folio.operators import resample as RS
    px = pixels(spark, {0: text_page(1.5), 1: text_page(0.0)})
    tilts = P.line_tilts(P.band_angles(P.band_points(px, 600))).collect()
    assert [t.image_id for t in tilts] == [0] and abs(tilts[0].angle - 1.5) < 0.2
    d = spark.createDataFrame([(0, 400, 520, float(tilts[0].angle), float(tilts[0].slope))], "image_id long, w int, h int, angle double, slope double")
    flat = RS.level_rows(px, d)
    again = P.line_tilts(P.band_angles(P.band_points(flat.repartition(4, "image_id"), 600))).collect()
    assert again == []


def test_border_and_blank(spark):
    from folio.plans import analyze as A
    page = text_page(0.0)
    framed = np.zeros((600, 480), dtype=int)
    framed[40:560, 40:440] = page
    blank = np.full((300, 200), 250)
    blank[100, 100] = 0
    px = pixels(spark, {0: framed, 1: blank, 2: page})
    images = px.select("image_id", "w", "h").distinct()
    got = {r.image_id: r for r in A.analyze_pages(images, px).collect()}
    assert got[1].is_blank and not got[0].is_blank and not got[2].is_blank
    assert got[0].crop is not None and abs(got[0].crop.x - 41 / 480) < 0.01 and "cropped" in got[0].summary
    assert got[2].crop is None and got[2].skew == 0


def test_black_white_look(spark):
    """Soft threshold on an evenly lit page: ink black, paper white, lone specks gone."""
    from folio.plans import looks as L
    a = text_page(0.0, 200, 200)
    a[10, 190] = 0
    out = back(L.apply_look(pixels(spark, {0: a}), "BlackWhite"), a.shape)
    assert out[10, 190] == 255 and out[100, 5] == 255
    assert (out[a == 30] < 128).mean() > 0.9


def test_linked_edges_equal_flood(spark):
    from folio.operators import edges as E
    rng = np.random.default_rng(5)
    mag = np.where(rng.random((20, 24)) > 0.6, rng.uniform(1, 12, (20, 24)), 0.0)
    rows = [(0, 24, 20, y, x, int(mag[y, x] * 1024), 0, int(mag[y, x] * 1024) ** 2) for y in range(20) for x in range(24) if mag[y, x] > 0]
    d = spark.createDataFrame(rows, "image_id long, w int, h int, y int, x int, gx long, gy long, m2 long")
    got = {(r.y, r.x) for r in E.linked_edges(d).collect()}
    m = np.floor(mag * 1024) / 1024
    want = {p for piece in flood(m >= 3.0) if any(m[q] >= 6.0 for q in piece) for p in piece}
    assert got == want


def test_square_is_found_as_lines(spark):
    from folio.operators import edges as E
    a = np.full((120, 160), 60)
    a[20:100, 30:130] = 220
    px = pixels(spark, {0: a}).select("image_id", "w", "h", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    lines = E.find_lines(px.repartition(4, "image_id")).collect()
    rhos = sorted(round(abs(r.rho)) for r in lines)
    for want in (20, 30, 100, 130):
        assert any(abs(x - want) <= 2 for x in rhos)
