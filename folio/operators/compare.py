"""Comparing pictures: mismatch with a truth picture, coarse frame fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.settings import luma_signature
from folio.operators import scanlines as SL


def mismatch(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``image_id, mismatch, lost_ink``: share of differing pixels, share of true ink not found.

    Both sides are tagged and met in one grouping by pixel, which needs no join and combines early.
    """
    both = found.select("image_id", "y", "x", F.when(F.col("v") == 0, 1).otherwise(0).alias("f"), F.lit(0).alias("t")).unionByName(
        truth.select("image_id", "y", "x", F.lit(0).alias("f"), F.when(F.col("v") == 0, 1).otherwise(0).alias("t")))
    px = both.groupBy("image_id", "y", "x").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    n = px.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") != F.col("t")).alias("bad"),
                                   F.count_if(F.col("t") == 1).alias("ink"), F.count_if((F.col("t") == 1) & (F.col("f") == 0)).alias("lost"))
    return n.select("image_id", F.round(F.col("bad") / F.col("n"), 6).alias("mismatch"),
                    F.round(F.col("lost") / F.greatest(F.lit(1), F.col("ink")), 6).alias("lost_ink"))


def _differing(found: np.ndarray, truth: bytes) -> dict:
    f, t = found.ravel() == 0, np.frombuffer(truth, np.uint8) == 0
    return {"n": t.size, "bad": int((f != t).sum()), "ink": int(t.sum()), "lost": int((t & ~f).sum())}


differing_of = SL.per_page(_differing, SL.record(**{c: T.LongType() for c in ("n", "bad", "ink", "lost")}))


def page_mismatch(pages: DataFrame) -> DataFrame:
    """:func:`mismatch` of pages of one row each with a second picture ``truth`` of the same size beside ``vals``."""
    n = pages.select("image_id", SL.of(differing_of, F.col("truth")).alias("n"))
    return n.select("image_id", F.round(F.col("n.bad") / F.col("n.n"), 6).alias("mismatch"),
                    F.round(F.col("n.lost") / F.greatest(F.lit(1), F.col("n.ink")), 6).alias("lost_ink"))


def frame_signature(rgb: DataFrame, cells: int = 8) -> DataFrame:
    """``image_id, cy, cx, level``: mean gray of a coarse grid, every second pixel."""
    px = rgb.filter((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    cy, cx = F.floor(F.col("y") * cells / F.col("h")).cast("int"), F.floor(F.col("x") * cells / F.col("w")).cast("int")
    return px.groupBy("image_id", cy.alias("cy"), cx.alias("cx")).agg(F.avg(luma_signature(F.col("r"), F.col("g"), F.col("b"))).alias("level"))
