"""Queries that read the whole table or search without caps."""

from __future__ import annotations

from harness import compare, duck
from pyspark.sql import functions as F

from folio import checks
from folio.operators import support
from folio.sources import tables as T


def test_latest_page_of_all_rows(spark, sf):
    queries, oracles = checks.load()
    name = "win_14_latest_page_of_all"
    result, _, _ = compare(spark, duck(sf), name, queries[name], oracles[name], sf)
    assert result.startswith("ok"), result
    newer = T.pages(spark, sf).filter(F.col("ts") >= F.lit("2000-01-01").cast("timestamp")).select("page_id")
    assert queries[name](spark, sf).join(newer, "page_id").count() > 0


def test_outlines_of_photos_have_no_caps(spark, sf, monkeypatch):
    queries, _ = checks.load()
    asked, whole = [], support.detect_outline
    monkeypatch.setattr(support, "detect_outline", lambda rgb, **settings: asked.append(settings) or rgb.select(
        "image_id", F.array(F.lit(0.0)).alias("quad"), F.lit(0.0).alias("confidence"), F.lit(False).alias("found")))
    queries["img_08_detect_outline"](spark, sf)
    queries["img_08_live_outline"](spark, sf)
    assert asked == [{}, {"frame_borders": False, "edge": 320, "most_lines": 40, "most_scored": 200}]
    assert whole.__defaults__[0] is True and whole.__defaults__[2:] == (None, None)
