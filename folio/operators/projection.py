"""Projection profiles: how far text lines lean, per page and per band.

Ink points are expanded by the candidate angles and counted into bins right away (a partial
aggregate), so what grows is arithmetic, not data held. Squared differences of neighbouring
bins need the empty bins too: each bin adds its count to itself and takes it from the next.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import settings as S
from folio.operators import raster as R
from folio.session import checkpointed

MAX_LEAN = 8.0        # fixed values of the levelling step
MIN_LEAN = 0.15
BANDS = 4


def scores(points: DataFrame, keys: list[str], bin_: Column, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """``keys, angle, score``: sum of squared differences of neighbouring bins.

    ``points`` has ``angle``; with ``lo``/``hi`` bins outside ``[lo, hi)`` are left out.
    """
    d = points.withColumn("b", bin_)
    if lo is not None:
        d = d.withColumns({"_lo": lo, "_hi": hi}).filter((F.col("b") >= F.col("_lo")) & (F.col("b") < F.col("_hi")))
    extra = [] if lo is None else ["_lo", "_hi"]
    bins = d.groupBy(*keys, "angle", "b", *extra).agg(F.count(F.lit(1)).alias("n"))
    ends = bins.select(*keys, "angle", *extra, F.explode(F.array(
        F.struct(F.col("b").alias("b"), F.col("n").alias("d")), F.struct((F.col("b") + 1).alias("b"), (-F.col("n")).alias("d")))).alias("e"))
    if lo is not None:
        ends = ends.filter((F.col("e.b") > F.col("_lo")) & (F.col("e.b") < F.col("_hi")))
    diff = ends.groupBy(*keys, "angle", F.col("e.b").alias("b")).agg(F.sum("e.d").alias("d"))
    return diff.groupBy(*keys, "angle").agg(F.sum(F.col("d") * F.col("d")).alias("score"))


def with_angles(points: DataFrame, start: Column, step: float, n: int) -> DataFrame:
    return points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("angle", start + F.col("_k") * F.lit(step)).drop("_k")


def _page_bin() -> Column:
    a = F.col("angle") * math.pi / 180
    return F.rint(F.col("y") * F.cos(a) - F.col("x") * F.sin(a)).cast("int")


def skew_points(px: DataFrame, dpi: int = 100) -> DataFrame:
    """Ink of each page away from its rim, where there is enough and not too much of it."""
    small = R.box_downscale(px, S.factor_for(dpi))
    cut = R.otsu(R.histogram(small))
    mx, my = F.floor(F.col("w") * 3 / 100), F.floor(F.col("h") * 3 / 100)
    ink = small.join(cut, "image_id").filter(
        (F.col("v") <= F.col("threshold")) & (F.col("x") >= mx) & (F.col("x") < F.col("w") - mx) & (F.col("y") >= my) & (F.col("y") < F.col("h") - my))
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    ink = ink.withColumn("n", n).filter((F.col("n") >= 200) & (F.col("n") <= F.floor(F.col("w").cast("bigint") * F.col("h") / 2)))
    return ink.select("image_id", "y", "x")


def best_angle(s: DataFrame, keys: list[str]) -> DataFrame:
    """Sharpest angle, the smallest on ties, with the score of leaving the page alone and the worst one."""
    m = s.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("m"),
                             F.max(F.when(F.col("angle") == 0, F.col("score"))).alias("zero"), F.min("score").alias("worst"))
    return m.select(*keys, (-F.col("m.a")).alias("best"), F.col("m.score").alias("best_score"), "zero", "worst")


def _finer(points: DataFrame, coarse: DataFrame, keys: list[str], half: float, step: float, bin_: Column, **limits) -> DataFrame:
    n = round(2 * half / step) + 1
    fine = scores(with_angles(points.join(coarse, keys), F.col("best") - half, step, n), keys, bin_, **limits)
    f = fine.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("m")).select(
        *keys, (-F.col("m.a")).alias("_f"), F.col("m.score").alias("_fs"))
    d = coarse.join(f, keys, "left")
    better = F.col("_fs") > F.col("best_score")
    return d.withColumns({"best": F.when(better, F.col("_f")).otherwise(F.col("best")),
                          "best_score": F.when(better, F.col("_fs")).otherwise(F.col("best_score"))}).drop("_f", "_fs")


SKEW_OUT = "best double, best_score long, zero long, worst long"


def _profile_score(y: np.ndarray, x: np.ndarray, angle: float) -> int:
    """Sum of squared differences of neighbouring bins of one page's ink at one angle."""
    a = angle * math.pi / 180
    bins = np.rint(y * math.cos(a) - x * math.sin(a)).astype(np.int64)
    steps = np.diff(np.bincount(bins - bins.min()), prepend=0, append=0)
    return int((steps * steps).sum())


def _sharpest(max_angle: float):
    """Coarse angles in steps of half a degree, then twentieths around the best; the smaller angle wins ties."""

    def search(ink: pd.DataFrame) -> pd.DataFrame:
        y, x = ink["y"].to_numpy(np.float64), ink["x"].to_numpy(np.float64)
        coarse = [(_profile_score(y, x, angle), -angle) for angle in (-max_angle + k * 0.5 for k in range(round(4 * max_angle) + 1))]
        best, zero, worst = max(coarse), next((s for s, a in coarse if a == 0), 0), min(coarse)[0]
        start = -best[1] - 0.5
        fine = max((_profile_score(y, x, angle), -angle) for angle in (start + k * 0.05 for k in range(21)))
        won = fine if fine[0] > best[0] else best
        return pd.DataFrame({"image_id": [ink["image_id"].iloc[0]], "best": [-won[1]], "best_score": [won[0]], "zero": [zero], "worst": [worst]})

    return search


def detect_skew(images: DataFrame, px: DataFrame, dpi: int = 100, max_angle: float = 15.0) -> DataFrame:
    """``image_id, skew`` in degrees, 0 without a confident estimate.

    Only ink travels to the profiles, one page at a time; a page at analysis size bounds what one call holds.
    """
    d = skew_points(px, dpi).groupBy("image_id").applyInPandas(_sharpest(max_angle), f"image_id {px.schema['image_id'].dataType.simpleString()}, {SKEW_OUT}")
    sure = (F.col("best_score") >= F.col("zero") * F.lit(1.05)) & (F.abs("best") >= 0.1)
    return images.select("image_id").join(d, "image_id", "left").select(
        "image_id", F.when(sure, F.col("best")).otherwise(0.0).alias("skew"))


# --- lean of text lines ------------------------------------------------------------

LONG_EDGE = 1200      # fixed value: lean is measured on pages of at most this length
WINDOWS = tuple(range(15, 62, 2))  # every local window that a page within that length can ask for


def measured(px: DataFrame, long_edge: int = LONG_EDGE) -> DataFrame:
    """Pages shrunk to ``long_edge``; shorter ones as they are."""
    from folio.operators import resample as RS
    big = px.filter(F.greatest("w", "h") > long_edge)
    images = big.select("image_id", "w", "h").distinct()
    scale = F.lit(float(long_edge)) / F.greatest("w", "h")
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale)).cast("int")
    small = RS.resize(big, images, side("w"), side("h"))
    keep = ["image_id", "w", "h", "y", "x", "v"]
    return px.filter(F.greatest("w", "h") <= long_edge).select(*keep).unionByName(small.select(*keep))


def band_points(px: DataFrame, long_edge: int = LONG_EDGE) -> DataFrame:
    """Ink of the four bands of a page, for lines across it and (transposed) down it.

    The ink is read twice (coarse and fine angles), so it is cut off from the raster work.
    """
    big = measured(px, long_edge).filter((F.col("w") >= 64) & (F.col("h") >= 64))
    win = F.least(F.greatest(F.floor(F.greatest("w", "h") / 40).cast("int").bitwiseOR(F.lit(1)), F.lit(15)), F.lit(61))
    binary = R.sauvola(big.withColumn("win", win), F.col("win"), S.SAUVOLA_K, windows=WINDOWS)
    ink = binary.filter("v = 0")
    both = ink.select("image_id", F.explode(F.array(
        F.struct(F.lit("rows").alias("dir"), F.col("w").alias("w"), F.col("h").alias("h"), F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct(F.lit("cols").alias("dir"), F.col("h").alias("w"), F.col("w").alias("h"), F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("image_id", "p.*")
    mx, my = F.floor(F.col("w") * 5 / 100), F.floor(F.col("h") * 4 / 100)
    both = both.withColumns({"mx": mx.cast("int"), "my": my.cast("int")}).withColumn("bh", F.floor((F.col("h") - 2 * F.col("my")) / BANDS).cast("int"))
    both = both.filter((F.col("x") >= F.col("mx")) & (F.col("x") < F.col("w") - F.col("mx")) & (F.col("y") >= F.col("my")))
    both = both.withColumn("band", F.floor((F.col("y") - F.col("my")) / F.col("bh")).cast("int")).filter(F.col("band") < BANDS)
    w = Window.partitionBy("image_id", "dir", "band")
    both = both.withColumns({"n": F.count(F.lit(1)).over(w), "min_y": F.min("y").over(w), "max_y": F.max("y").over(w)})
    area = F.col("bh").cast("bigint") * (F.col("w") - 2 * F.col("mx"))
    both = both.filter((F.col("n") >= 150) & (F.col("n") <= area * F.lit(0.45)))
    keep = ["image_id", "dir", "band", "w", "h", "x", "y", "my", "bh", "n", "min_y", "max_y"]
    return checkpointed(both.select(*keep))


def band_angles(points: DataFrame) -> DataFrame:
    """``image_id, dir, band, angle, contrast, n, v`` of each measured band."""
    keys = ["image_id", "dir", "band"]
    info = points.groupBy(*keys).agg(F.first("n").alias("n"), F.first("h").alias("h"), F.first("my").alias("my"), F.first("bh").alias("bh"))
    span = F.col("max_y") - F.col("min_y") + F.floor(F.col("w") * F.lit(math.tan(MAX_LEAN * math.pi / 180))) + 4
    pts = points.withColumn("span", span.cast("int"))
    pts = pts.withColumn("off", (-F.col("min_y") + F.floor(F.col("span") / 2) - F.floor((F.col("max_y") - F.col("min_y")) / 2)).cast("int"))
    pts = pts.select(*keys, "x", "y", "w", "span", "off")
    bin_ = F.rint(F.col("y") - F.tan(F.col("angle") * math.pi / 180) * (F.col("x") - F.col("w") / 2)).cast("int") + F.col("off")
    limits = {"lo": F.lit(0), "hi": F.col("span") + 2}
    coarse = best_angle(scores(with_angles(pts, F.lit(-MAX_LEAN), 0.25, 65), keys, bin_, **limits), keys)
    d = _finer(pts, coarse, keys, 0.25, 0.025, bin_, **limits)
    contrast = F.when(F.col("worst") > 0, F.col("best_score") / F.col("worst")).otherwise(1.0)
    y0 = F.col("my") + F.col("band") * F.col("bh")
    return d.filter("best_score > 0").join(info, keys).select(
        *keys, F.col("best").alias("angle"), contrast.alias("contrast"), "n", (((y0 + y0 + F.col("bh")) / 2.0) / F.col("h")).alias("v"))


def line_tilts(bands: DataFrame) -> DataFrame:
    """``image_id, angle, slope, bands`` of pages whose text visibly leans; at most four bands per page and direction."""
    key = ["image_id", "dir"]
    w = Window.partitionBy(*key)
    d = bands.withColumns({"quality": F.avg(F.least(F.col("contrast"), F.lit(50.0))).over(w), "good": F.col("contrast") >= 1.15})
    # the angle in the middle of the clear bands; bands far from it (a picture, a stamp) do not count
    g = Window.partitionBy(*key, "good")
    d = d.withColumn("_k", F.row_number().over(g.orderBy("angle", "band"))).withColumn("_c", F.count(F.lit(1)).over(g))
    d = d.withColumn("_mid", F.max(F.when(F.col("good") & (F.col("_k") == F.floor(F.col("_c") / 2) + 1), F.col("angle"))).over(w))
    near = F.col("good") & (F.abs(F.col("angle") - F.col("_mid")) <= 1.5)
    d = d.withColumn("wt", F.when(near, F.col("n") * F.least(F.col("contrast"), F.lit(3.0))))
    sw = F.sum("wt").over(w)
    d = d.withColumns({"mv": F.sum(F.col("wt") * F.col("v")).over(w) / sw, "ma": F.sum(F.col("wt") * F.col("angle")).over(w) / sw})
    both = d.groupBy(*key, "quality", "mv", "ma").agg(
        F.count("wt").alias("bands"), F.sum(F.col("wt") * (F.col("v") - F.col("mv")) * (F.col("v") - F.col("mv"))).alias("svv"),
        F.sum(F.col("wt") * (F.col("v") - F.col("mv")) * (F.col("angle") - F.col("ma"))).alias("sva"))
    slope = F.when((F.col("bands") >= 2) & (F.col("svv") > 1e-6), F.col("sva") / F.when(F.col("svv") > 1e-6, F.col("svv"))).otherwise(0.0)
    both = both.withColumn("slope", F.least(F.greatest(slope, F.lit(-3.0)), F.lit(3.0)))
    both = both.withColumn("angle", F.col("ma") + F.col("slope") * (0.5 - F.col("mv")))
    page = both.groupBy("image_id").agg(*[F.max(F.when(F.col("dir") == d, F.struct("quality", "angle", "slope", "bands"))).alias(d) for d in ("rows", "cols")])
    across = F.coalesce(F.col("cols.quality"), F.lit(0.0)) > F.coalesce(F.col("rows.quality"), F.lit(0.0))
    page = page.select("image_id", F.when(across, -F.col("cols.angle")).otherwise(F.col("rows.angle")).alias("angle"),
                       F.when(across, 0.0).otherwise(F.col("rows.slope")).alias("slope"),
                       F.when(across, F.col("cols.bands")).otherwise(F.col("rows.bands")).alias("bands"))
    at0, at1 = F.abs(F.col("angle") - F.col("slope") / 2), F.abs(F.col("angle") + F.col("slope") / 2)
    return page.filter((F.greatest(at0, at1) >= MIN_LEAN) & (F.abs("angle") <= MAX_LEAN) & (at0 <= MAX_LEAN - 0.3) & (at1 <= MAX_LEAN - 0.3))
