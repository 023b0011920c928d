"""Geometry rules on literal cases and random ones."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import geometry as G

SIZES = [(1240, 1754), (800, 1000), (900, 900), (300, 2000)]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def quad(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_orientation_algebra(spark):
    """Turning is a group: four quarter turns are the identity for every tag; -90 undoes 90."""
    rows = spark.range(0, 10).select(F.col("id").cast("int").alias("e"))
    d = rows.select("e", *[G.compose_rotation(F.col("e"), F.lit(k)).alias(f"t{k % 360}") for k in (90, 360)],
                    G.compose_rotation(G.compose_rotation(F.col("e"), F.lit(90)), F.lit(-90)).alias("undo"))
    for r in d.collect():
        start = r.e if 1 <= r.e <= 8 else 1
        assert r.t0 == start and r.undo == start
    assert one(spark, a=G.compose_rotation(F.lit(1), F.lit(90)), b=G.compose_rotation(F.lit(6), F.lit(90))) == (6, 3)


def test_four_turns_of_an_outline(spark):
    q = quad(0.1, 0.2, 0.8, 0.15, 0.9, 0.85, 0.05, 0.9)
    r = q
    for _ in range(4):
        r = G.quad_rotate_cw(r)
    got = one(spark, q=q, r=r, two=G.rotate_quad(q, F.lit(2)), twice=G.quad_rotate_cw(G.quad_rotate_cw(q)))
    assert got.q == pytest.approx(got.r) and got.two == pytest.approx(got.twice)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 40), min_size=8, max_size=8))
def test_homography_maps_the_rectangle_onto_the_outline(j):
    spark = pytest.importorskip("pyspark.sql").SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("needs the session")
    pts = [0 + j[0], 0 + j[1], 300 - j[2], 0 + j[3], 300 - j[4], 400 - j[5], 0 + j[6], 400 - j[7]]
    m = G.homography(quad(*pts), F.lit(210.0), F.lit(297.0))
    d = spark.range(1).select(m.alias("m")).withColumn("i", G.homography_inverse(F.col("m")))
    x, y = G.homography_apply(F.col("m"), F.lit(210.0), F.lit(297.0))
    u, v = G.homography_apply(F.col("i"), x, y)
    r = d.select(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")).first()
    assert (r.x, r.y) == pytest.approx((pts[4], pts[5]), abs=1e-6) and (r.u, r.v) == pytest.approx((210, 297), abs=1e-6)


def test_contains_and_area(spark):
    q = quad(0, 0, 10, 0, 10, 10, 0, 10)
    r = one(spark, a=G.quad_area(q), i=G.quad_contains(q, F.lit(5.0), F.lit(5.0)), e=G.quad_contains(q, F.lit(0.0), F.lit(5.0)), o=G.quad_contains(q, F.lit(11.0), F.lit(5.0)))
    assert r == (100.0, True, True, False)


@pytest.mark.parametrize("w,h", SIZES)
def test_a4_like(spark, w, h):
    q = quad(0, 0, w, 0, w, h, 0, h)
    ratio = max(w, h) / min(w, h)
    assert one(spark, a=G.is_a4_like(q)).a == (1.15 <= ratio <= 1.75)


def test_front_view_keeps_its_shape(spark):
    d = spark.createDataFrame([([500.0, 500.0, 1500.0, 500.0, 1500.0, 1900.0, 500.0, 1900.0], 2000, 2400)], "quad array<double>, w int, h int")
    r = G.with_output_aspect(G.with_output_aspect(d, a4=False, name="free"), a4=True).first()
    assert r.free == pytest.approx(1000 / 1400, rel=1e-6) and r.aspect == pytest.approx(1 / math.sqrt(2), rel=1e-6)


def test_crop_plan_uses_a_coarser_decode_for_huge_photos(spark):
    d = spark.createDataFrame([([0.0, 0.0, 8000.0, 0.0, 8000.0, 11314.0, 0.0, 11314.0], 8000, 11314)], "quad array<double>, w int, h int")
    r = G.with_crop_plan(d).first()
    assert r.sample in (2, 4) and max(r.out_w, r.out_h) <= 3508 and r.region_w == 8000


def test_estimate_dpi(spark):
    r = one(spark, a=G.estimate_dpi(F.lit(2481), F.lit(3507)), b=G.estimate_dpi(F.lit(2550), F.lit(3300)), c=G.estimate_dpi(F.lit(0), F.lit(5)))
    assert r == (300, 300, 200)


def test_pick_outline_prefers_a_far_stronger_rival(spark):
    from folio.operators import outline as OL
    q1, q2, q3 = ([float(v) for v in q] for q in ((10, 10, 200, 10, 200, 150, 10, 150), (12, 11, 199, 12, 198, 149, 11, 148), (10, 10, 60, 10, 60, 60, 10, 60)))
    rows = [(1, 1, q1, 0.8, 10.0), (1, 2, q2, 0.7, 40.0), (1, 3, q3, 0.75, 90.0), (2, 1, q1, 0.5, 10.0), (2, 2, q2, 0.3, 50.0)]
    d = spark.createDataFrame(rows, "image_id long, cand_id long, quad array<double>, score double, strength double")
    assert {r.image_id: r.cand_id for r in OL.pick_outline(d, 240, 180).collect()} == {1: 2, 2: 1}


def test_robust_line_ignores_outliers(spark):
    from folio.operators import outline as OL
    rows = [(1, i / 40, 3 + 2 * i / 40 if i % 9 else 60.0, 30.0) for i in range(40)]
    r = OL.robust_lines(spark.createDataFrame(rows, "side_id long, t double, e double, s double")).first()
    assert r.p0 == pytest.approx(3, abs=0.05) and r.p1 == pytest.approx(2, abs=0.1)


def plain_fit(t, e, s, terms):
    """The same fit for one side in numpy."""
    import numpy as np
    t, e, s = map(np.asarray, (t, e, s))
    basis = np.column_stack([np.ones_like(t), t] if terms == 2 else [np.ones_like(t), t, t * (1 - t), t * t * (1 - t)])
    w, p = np.sqrt(s), None
    for _ in range(6):
        m = (basis * w[:, None]).T @ basis
        if abs(np.linalg.det(m)) < 1e-9:
            return p
        p = np.linalg.solve(m, (basis * w[:, None]).T @ e)
        r = np.abs(e - basis @ p)
        u = r / (max(1.0, 1.4826 * float(np.median(r))) * 4.685)
        w = np.where(u < 1, np.sqrt(s) * (1 - u * u) ** 2, 0.0)
        if (u < 1).sum() < max(8, 3 * terms):
            return None
    return p


@pytest.mark.parametrize("terms", [2, 4])
def test_side_fits_equal_numpy_and_give_up_below_the_least_samples(spark, terms):
    import random
    from folio.operators import outline as OL
    rng, rows, want = random.Random(3), [], {}
    for side, n in enumerate((5, 7, 8, 11, 12, 40, 40)):
        t = [(i + 0.5) / n for i in range(n)]
        e = [5 + 8 * x + (6 * x * (1 - x) if side == 6 else 0) + rng.uniform(-1, 1) + (70 if i % 13 == 5 and n == 40 else 0) for i, x in enumerate(t)]
        s = [rng.uniform(14, 60) for _ in t]
        rows += [(side, a, b, c) for a, b, c in zip(t, e, s)]
        want[side] = plain_fit(t, e, s, terms)
    got = OL.robust_lines(spark.createDataFrame(rows, "side_id long, t double, e double, s double"), terms=terms).collect()
    for r in got:
        p = want[r.side_id]
        assert (r.p0 is None) == (p is None)
        if p is not None:
            assert [r[f"p{i}"] for i in range(terms)] == pytest.approx(list(p), abs=1e-6)
    assert want[0] is None and want[5] is not None
