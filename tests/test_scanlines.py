"""Pages of one row against the operators on one row per pixel and against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import raster as R
from folio.operators import sampling as SM
from folio.operators import scanlines as SL
from folio.plans import analyze as A
from folio.sources import tables as T


@pytest.fixture(scope="module")
def pages(spark, sf):
    return T.text_pages(spark, sf).filter("image_id < 40")


def by_id(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pixels_of_both_forms_are_equal(spark, sf, pages):
    same = ["image_id", "w", "h", "y", "x", "v"]
    assert by_id(SL.pixels(pages), *same) == by_id(T.text_pixels(spark, sf).filter("image_id < 40"), *same)
    a, b = SL.pixels(T.mosaic_pages(spark, sf)).select(*same), T.mosaic_pixels(spark, sf).select(*same)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rules_of_both_forms_are_equal(spark, sf, pages):
    px, images = T.text_pixels(spark, sf).filter("image_id < 40"), T.text_images(spark, sf).filter("image_id < 40")
    ink = lambda d: by_id(d.withColumn("i", F.round("ink_percent", 9)), "image_id", "i")
    assert ink(A.page_ink_percent(pages)) == ink(A.ink_percent(images, px))
    box = ["image_id", "x0", "y0", "x1", "y1"]
    assert by_id(A.page_content_bounds(pages, 200), *box) == by_id(A.content_bounds(px, 200), *box)
    soft = SL.digest(SL.sauvola(pages, 31, 0.3, 25.6, 12.0))
    assert by_id(soft, "image_id", "n", "total", "placed") == by_id(R.sauvola(px, 31, 0.3, 25.6, 12.0).groupBy("image_id").agg(*R.digest()), "image_id", "n", "total", "placed")


def test_looks_of_both_forms_are_equal(spark, sf, pages):
    from folio.plans import looks as LK
    px = T.text_pixels(spark, sf).filter("image_id < 40")
    cols = ["image_id", "n", "total", "placed"]
    rows = lambda d: by_id(d.groupBy("image_id").agg(*R.digest()), *cols)
    assert by_id(SL.digest(SL.black_white(pages.filter("h > 0"))), *cols) == rows(LK.apply_look(px, "BlackWhite"))
    assert by_id(SL.digest(SL.unsharp(pages.filter("h > 0"), 3)), *cols) == rows(R.unsharp(px, 3))


def test_planes_are_evened_one_by_one():
    rng = np.random.default_rng(3)
    p = np.clip(np.array([230, 200, 150]) - 40 * (np.arange(90) / 90)[:, None, None] + rng.integers(-3, 4, (90, 70, 3)), 0, 255).astype(np.uint8)
    got = SL._flattened_planes(p)
    assert all((got[..., c] == SL._flattened(np.ascontiguousarray(p[..., c]))).all() for c in range(3)) and got.mean((0, 1)).min() > 240
    assert SL._flattened(np.zeros((5000, 3), np.uint8)) is None  # too narrow for its length


def test_empty_and_null_pages(spark):
    rows = [(1, 0, 0, b""), (2, 3, 2, bytes([0, 255, 9, 9, 255, 0])), (3, 3, 2, None)]
    d = spark.createDataFrame(rows, "image_id long, w int, h int, vals binary")
    assert by_id(SL.histogram(d.filter("vals IS NOT NULL")), "image_id", "v", "n") == [(2, 0, 2), (2, 9, 2), (2, 255, 2)]
    got = {r.image_id: r for r in SL.local_stats(d, 3).collect()}
    assert got[3].mean is None and got[1].mean == [] and len(got[2].variance) == 6
    assert {r.image_id: r.vals for r in SL.shrink(d, 2).collect()}[2] == bytes([(0 + 255 + 9 + 255) // 4])


def flood(ink, most):
    """Ink left and pieces of at most ``most`` pixels, by walking."""
    h, w = ink.shape
    seen, left, specks = np.zeros_like(ink), 0, 0
    for y in range(h):
        for x in range(w):
            if ink[y, x] and not seen[y, x]:
                stack, size = [(y, x)], 0
                seen[y, x] = True
                while stack:
                    a, b = stack.pop()
                    size += 1
                    for i in range(max(0, a - 1), min(h, a + 2)):
                        for j in range(max(0, b - 1), min(w, b + 2)):
                            if ink[i, j] and not seen[i, j]:
                                seen[i, j] = True
                                stack.append((i, j))
                specks += size <= most
                left += size if size > most else 0
    return left, specks


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.integers(1, 14), st.integers(1, 6), st.floats(0.05, 0.6))
def test_specks_equal_a_flood(seed, h, w, most, share):
    ink = np.random.default_rng(seed).random((h, w)) < share
    assert SL.ink_and_specks(ink, most) == flood(ink, most)


def test_window_sums_equal_plain_ones():
    rng = random.Random(1)
    for h, w, half in ((1, 1, 3), (5, 9, 2), (8, 3, 0), (6, 6, 10)):
        a = np.array([[rng.randint(0, 255) for _ in range(w)] for _ in range(h)])
        want = [[a[max(0, y - half):y + half + 1, max(0, x - half):x + half + 1].sum() for x in range(w)] for y in range(h)]
        assert (SL._window_sums(a, half) == want).all()


def test_curved_sides_land_on_the_borders(spark, sf):
    """A drawn sheet with bulging sides becomes all paper only when its bends are given."""
    rows = T.sheet_pages(spark, sf).limit(3)
    args = [F.col("quad"), F.lit(200), F.lit(150)]
    rim = SL.per_page(lambda p: float(np.concatenate([p[3, 10:-10], p[-4, 10:-10], p[10:-10, 3], p[10:-10, -4]]).mean()), T_DOUBLE, planes=3)
    flat, bent = SM.warp(rows, *args, planes=3), SM.warp(rows, *args, F.col("bends"), planes=3)
    value = lambda d: {r.image_id: r.v for r in d.select("image_id", SL.of(rim).alias("v")).collect()}
    flat, bent = value(flat), value(bent)
    assert all(bent[i] > 200 for i in bent) and all(bent[i] >= flat[i] - 1 for i in bent)


T_DOUBLE = SL.DOUBLES.elementType
