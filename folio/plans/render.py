"""Stale pages: what to decode, how big the result is, and the straightened picture itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.operators import resample as RS
from folio.plans import looks as LK


def render_plan(pages: DataFrame, stale: Column, a4: bool = True) -> DataFrame:
    """Only pages whose render is stale, with region, sample and output size, dpi and the next revision."""
    d = G.with_crop_plan(pages.filter(stale), a4=a4)
    return d.withColumns({"dpi": G.page_dpi(F.col("out_w"), F.col("out_h")), "revision": F.col("revision") + 1})


def render_pages(px: DataFrame, plan: DataFrame, look: str = "Gray", **options) -> DataFrame:
    """Gray pages straightened, turned and given their look.

    ``plan``: ``image_id, w, h, quad, out_w, out_h, turns``; pictures at preview size.
    """
    flat = RS.warp(px, plan.select("image_id", "w", "h", "quad", "out_w", "out_h"), F.col("quad"), F.col("out_w"), F.col("out_h"))
    d = flat.join(plan.select("image_id", "turns"), "image_id")
    t, w, h, x, y = F.pmod("turns", F.lit(4)), F.col("w"), F.col("h"), F.col("x"), F.col("y")
    d = d.withColumns({"x": F.when(t == 1, h - 1 - y).when(t == 2, w - 1 - x).when(t == 3, y).otherwise(x),
                       "y": F.when(t == 1, x).when(t == 2, h - 1 - y).when(t == 3, w - 1 - x).otherwise(y),
                       "w": F.when(t % 2 == 1, h).otherwise(w), "h": F.when(t % 2 == 1, w).otherwise(h)}).drop("turns")
    return LK.apply_look(d, look, **options)
