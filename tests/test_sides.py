"""Refined outlines: helpers against the DataFrame operators of the same steps, and odd pages."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import outline as OL
from folio.operators import sides as SD
from folio.sources import tables as T


def samples(seed, n=40, bulge=0.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(np.linspace(0.04, 0.96, 64), n, replace=False))
    e = 3 - 5 * t + bulge * t * (1 - t) * 4 + rng.normal(0, 0.4, n)
    wild = rng.random(n) < 0.15
    return t, np.where(wild, e + rng.uniform(10, 40, n), e).round(3), rng.integers(15, 90, n).astype(float)


def test_fits_equal_the_set_operators(spark):
    rows, cases = [], {k: samples(k, bulge=k % 3 * 4) for k in range(6)}
    for side, (t, e, s) in cases.items():
        rows += [(side, k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(t, e, s))]
    df = spark.createDataFrame(rows, "side_id long, k long, t double, e double, s double")
    lines = {r.side_id: r for r in OL.consensus_lines(df, 2.5).collect()}
    two, four = ({r.side_id: r for r in OL.robust_lines(df, terms=n).collect()} for n in (2, 4))
    for side, (t, e, s) in cases.items():
        a, b = SD.consensus(t, e, s, 2.5)
        assert (a, b) == pytest.approx((lines[side].a, lines[side].b), abs=1e-9)
        assert SD.tukey_fit(t, e, s, 2) == pytest.approx([two[side].p0, two[side].p1], abs=1e-6)
        assert SD.tukey_fit(t, e, s, 4) == pytest.approx([four[side][f"p{i}"] for i in range(4)], abs=1e-5)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.booleans(), st.integers(0, 9)), min_size=12, max_size=12), min_size=1, max_size=4))
def test_outermost_run_equals_a_walk(rows):
    passes, step = (np.array([[c[k] for c in r] for r in rows]) for k in (0, 1))
    want = []
    for r in rows:
        end = max((i for i, (ok, _) in enumerate(r) if ok), default=-1)
        begin = end
        while begin > 0 and r[begin - 1][0]:
            begin -= 1
        want.append(-1 if end < 0 else max(range(begin, end + 1), key=lambda i: (r[i][1], -i)))
    assert SD._outermost(passes.astype(bool), step.astype(float)).tolist() == want


def test_paper_is_the_bright_part():
    p = np.full((100, 100, 3), 90, np.uint8)
    p[:, 50:] = (240, 230, 220)
    got = SD._paper(p, [0, 0, 100, 0, 100, 100, 0, 100])
    assert tuple(got.values()) == pytest.approx((240, 230, 220))
    assert SD._paper(p, [500, 500, 600, 500, 600, 600, 500, 600]) == dict.fromkeys("rgb", 255.0)


def test_sheets_are_refined_and_odd_pages_kept(spark, sf):
    pages = T.sheet_pages(spark, sf).withColumn("quad", F.col("coarse"))
    odd = pages.limit(1).withColumn("image_id", F.lit(10**6).cast("long"))
    flat = odd.withColumn("vals", F.unhex(F.repeat(F.lit("80"), 640 * 480 * 3)))  # nothing to see
    far = odd.withColumns({"image_id": F.lit(10**6 + 1).cast("long"), "quad": F.transform("quad", lambda v: v + 2000)})
    none = odd.withColumns({"image_id": F.lit(10**6 + 2).cast("long"), "quad": F.lit(None).cast("array<double>")})
    got = {r.image_id: r for r in SD.refine_outline(pages.unionByName(flat).unionByName(far).unionByName(none)).collect()}
    truth = T.sheet_outlines(spark, sf).collect()
    assert truth
    for r in truth:
        err = np.hypot(*(np.array(got[r.image_id].quad) - r.quad).reshape(4, 2).T).max()
        assert err <= 8 and got[r.image_id].refined == 4, (r.image_id, err)
    assert got[10**6].refined == 0 and got[10**6].bends is None and got[10**6 + 1].refined == 0
    assert 10**6 + 2 not in got


def test_a_sharp_border_is_found_between_pixels():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:200, 0:200] + 0.5
    for place in (100.0, 100.3, 101.75):
        ramp = np.clip(0.5 + (place - x) / 3, 0, 1)[..., None] * 150 + 70  # paper left of a border three pixels soft
        p = np.clip(ramp + rng.normal(0, 2, (200, 200, 3)), 0, 255).astype(np.uint8)
        got = SD._side_points(p, np.array([100.0, 20]), np.array([100.0, 180]), np.array([1.0, 0]), 20.0, np.array([220.0] * 3))
        assert len(got["e"]) == SD.PLACES and np.abs(got["e"] - (place - 100)).max() < 0.3
    assert SD._middle(np.array([[np.nan, 9.0, 9, 2, 0, 0]]), np.array([1])).tolist() == [1]  # cut off on one side
    assert SD._middle(np.array([[0.0, 9, 9, 9, 0, 0]]), np.array([1])).tolist() == pytest.approx([2])


def test_bulges_of_soft_sheets_equal_the_sql(spark, tmp_path):
    from folio import checks
    from harness import compare
    keys = "(838, 7, 6190.0), (886, 6, 7287.0)"  # a straight side was found bent, a bent one straight
    con = duckdb.connect()
    con.execute(f"CREATE TABLE supplier AS SELECT k::BIGINT AS s_suppkey, n::INTEGER AS s_nationkey, b::DOUBLE AS s_acctbal FROM (VALUES {keys}) v(k, n, b)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    name, (queries, oracles) = "img_09_refine_outline", checks.load()
    assert compare(spark, con, name, queries[name], oracles[name], str(tmp_path))[0] == "ok 2"
