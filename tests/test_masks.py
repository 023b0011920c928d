"""Signatures drawn into masks against a row per pixel of every segment's box."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folio.operators import ink as I
from folio.operators import raster as R


def test_masks_equal_a_row_per_pixel(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(s, t, k, float(rng.integers(0, 190)), float(rng.integers(0, 60))) for s in range(4) for t in range(3) for k in range(12)]
    rows += [(10, 0, 0, 5.0, 5.0), (11, 0, 0, 0.0, 7.0), (11, 0, 1, 50.0, 7.0), (12, 0, 0, 3.0, 0.0), (12, 0, 1, 3.0, 40.0), (12, 1, 0, 0.0, 0.0), (12, 1, 1, 1e-12, 1e-12)]
    pts = spark.createDataFrame(rows, "signature_id long, stroke int, k int, x double, y double").repartition(4)
    monkeypatch.setattr(I, "CHUNK", 5)
    d = I.raster_masks(pts, 3.0, 120)
    assert all(len(r.mask) == 2 * r.w * r.h for r in d.collect())
    got = d.select("signature_id", I.mask_digest_of(F.col("mask"), F.col("w")).alias("d")).select("signature_id", "d.*")
    want = I.rasterize(pts, 3.0, 120).withColumn("image_id", F.col("signature_id")).groupBy("signature_id").agg(*R.digest())
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    assert "posexplode" not in str(got._jdf.queryExecution().executedPlan()).lower()


def test_masks_of_a_spread_signature_are_laid_over_each_other(spark, monkeypatch):
    pts = spark.createDataFrame([(1, t, k, float(t * 9 + k), float(k * 7 % 30)) for t in range(20) for k in range(8)], "signature_id long, stroke int, k int, x double, y double")
    whole = I.raster_masks(pts, 3.0, 120).collect()
    monkeypatch.setattr(I, "SPREAD", 10)
    assert I.raster_masks(pts, 3.0, 120).collect() == whole and len(whole) == 1


def test_segments_are_not_broadcast(spark, sf):
    from folio import checks
    p = checks.load()[0]["join_19_stroke_raster"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in p and "SortMergeJoin" in p
