"""How a page finally looks: even lighting, threshold, tone, thumbnails, stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import settings as S
from folio.functions import stamps as ST
from folio.functions import tone as TN
from folio.operators import raster as R
from folio.operators import resample as RS


def apply_tone(px: DataFrame, brightness, contrast, *values: str) -> DataFrame:
    s, o = TN.tone_scale(contrast), TN.tone_offset(brightness, contrast)
    return px.withColumns({c: TN.tone_level(F.col(c), s, o) for c in values or ("v",)})


def black_white_source(px: DataFrame, dpi: int = 100, clean: bool = True, sharpen: bool = True) -> DataFrame:
    """The gray page before the threshold: even lighting, sharpened."""
    d = RS.flatten_background(px) if clean else px
    return R.unsharp(d, S.radius_for(dpi), S.UNSHARP_AMOUNT) if sharpen else d


def despeckle(px: DataFrame, dpi: int = 100) -> DataFrame:
    """Specks, found on the black and white version (darker than 128), become paper."""
    specks = R.small_components(px.filter("v < 128"), S.area_for(dpi)).withColumn("_speck", F.lit(True))
    d = px.join(specks.drop("label"), ["image_id", "y", "x"], "left")
    return d.withColumn("v", F.when(F.col("_speck"), 255).otherwise(F.col("v"))).drop("_speck")


def apply_look(px: DataFrame, mode: str, dpi: int = 100, darkness: int = 50, brightness: int = 0, contrast: int = 0, clean: bool = True,
               remove_specks: bool = True, method: str = "sauvola", sharpen: bool = True, smooth: bool = True) -> DataFrame:
    """Gray pages in their final look (``Color`` pages take their planes through ``apply_tone``)."""
    if mode == "Gray":
        d = RS.flatten_background(px) if clean else px
        return d if brightness == contrast == 0 else apply_tone(d, F.lit(brightness), F.lit(contrast))
    if mode == "Color":
        return px if brightness == contrast == 0 else apply_tone(px, F.lit(brightness), F.lit(contrast))
    gray = black_white_source(px, dpi, clean, sharpen)
    levels = max(-100, min(100, brightness)) * 1.28
    if method == "otsu":
        shift = round((min(max(darkness, 0), 100) - 50) * 0.8) - round(levels)
        cut = R.otsu(R.histogram(gray)).withColumn("threshold", F.least(F.greatest(F.col("threshold") + shift, F.lit(1)), F.lit(254)))
        d = gray.join(cut, "image_id").withColumn("v", R.shade(F.col("v"), F.col("threshold"))).drop("threshold")
    else:
        d = R.sauvola(gray, S.window_for(dpi), S.k_for(darkness), levels, S.SMOOTH_RAMP if smooth else 0.0)
    return despeckle(d, dpi) if remove_specks else d


def look_grid(stats: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """``image_id, darkness, brightness, n, ink`` for many settings over one set of local statistics.

    The settings list is a job parameter; every pixel is compared with all of them in one pass.
    """
    hits = []
    for d, b in settings:
        t = R.sauvola_threshold(F.col("mean"), F.sqrt("variance"), S.k_for(d), b * 1.28)
        hits.append(F.count_if(F.col("v") <= t).alias(f"{d}_{b}"))
    wide = stats.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(*[F.struct(F.lit(d).alias("darkness"), F.lit(b).alias("brightness"), F.col(f"{d}_{b}").alias("ink")) for d, b in settings])
    return wide.select("image_id", "n", F.explode(rows).alias("r")).select("image_id", "n", "r.*")


def thumbs(px: DataFrame, images: DataFrame, edge: int) -> DataFrame:
    """Pictures resized so the long edge is at most ``edge``; never enlarged."""
    ow, oh = G.fit_long_edge(F.col("w"), F.col("h"), edge)
    return RS.resize(px, images, ow, oh)


def apply_ops(px: DataFrame, ops: DataFrame) -> DataFrame:
    """Crop (fractions), then deskew (bilinear), then quarter turn, per image.

    ``ops``: ``image_id, cx, cy, cw, ch`` (null without a crop), ``skew`` degrees, ``turns``.
    """
    d = px.join(ops, "image_id")
    x0 = F.coalesce(F.rint(F.col("cx") * F.col("w")), F.lit(0)).cast("int")
    y0 = F.coalesce(F.rint(F.col("cy") * F.col("h")), F.lit(0)).cast("int")
    nw = F.coalesce(F.greatest(F.lit(1), F.rint(F.col("cw") * F.col("w"))), F.col("w")).cast("int")
    nh = F.coalesce(F.greatest(F.lit(1), F.rint(F.col("ch") * F.col("h"))), F.col("h")).cast("int")
    d = d.withColumns({"_x0": x0, "_y0": y0, "_nw": F.least(nw, F.col("w") - x0), "_nh": F.least(nh, F.col("h") - y0)})
    d = d.filter((F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x0") + F.col("_nw")) & (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y0") + F.col("_nh")))
    d = d.withColumns({"x": F.col("x") - F.col("_x0"), "y": F.col("y") - F.col("_y0"), "w": F.col("_nw"), "h": F.col("_nh")})
    cropped = d.select("image_id", "w", "h", "y", "x", "v")
    sizes = d.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.first("skew").alias("skew"), F.first("turns").alias("turns"))
    tilts = sizes.filter("skew <> 0").select("image_id", "w", "h", F.col("skew").alias("angle"), F.lit(0.0).alias("slope"))
    straight = RS.level_rows(cropped, tilts).join(sizes.select("image_id", "turns"), "image_id")
    t, w, h, x, y = F.col("turns"), F.col("w"), F.col("h"), F.col("x"), F.col("y")
    return straight.withColumns({
        "x": F.when(t == 1, h - 1 - y).when(t == 2, w - 1 - x).when(t == 3, y).otherwise(x),
        "y": F.when(t == 1, x).when(t == 2, h - 1 - y).when(t == 3, w - 1 - x).otherwise(y),
        "w": F.when(t % 2 == 1, h).otherwise(w), "h": F.when(t % 2 == 1, w).otherwise(h)}).drop("turns")


def stamp_coverage(stamps: DataFrame, masks: DataFrame) -> DataFrame:
    """``image_id, ord, y, x, alpha, color``: ink of each placed signature per page pixel.

    ``stamps``: ``image_id, ord, signature_id, cx, cy, size, turns, w, h`` (page size);
    ``masks``: ``signature_id, mw, mh, my, mx, v, color``. The footprint is expanded from the
    stamp row, each pixel meets its upper-left mask tap by equi-join.
    """
    ids = masks.groupBy("signature_id").agg(F.first("mw").alias("mw"), F.first("mh").alias("mh"), F.first("color").alias("color"))
    d = stamps.join(ids, "signature_id")
    fw, fh = ST.stamp_footprint(F.col("size"), F.col("turns"), F.col("mw"), F.col("mh"), F.col("w"), F.col("h"))
    d = d.withColumns({"fw": fw, "fh": fh}).filter((F.col("fw") >= 1) & (F.col("fh") >= 1))
    d = d.withColumns({"left": F.col("cx") * F.col("w") - F.col("fw") / 2, "top": F.col("cy") * F.col("h") - F.col("fh") / 2})
    d = d.withColumn("k", F.when(F.col("turns") % 2 == 0, F.col("mw")).otherwise(F.col("mh")) / F.col("fw"))
    x0, x1 = F.greatest(F.lit(0), F.floor("left")), F.least(F.col("w") - 1, F.ceil(F.col("left") + F.col("fw")))
    y0, y1 = F.greatest(F.lit(0), F.floor("top")), F.least(F.col("h") - 1, F.ceil(F.col("top") + F.col("fh")))
    d = d.filter((x0 <= x1) & (y0 <= y1)).withColumn("y", F.explode(F.sequence(y0, y1))).withColumn("x", F.explode(F.sequence(x0, x1)))
    a, b = (F.col("x") + 0.5 - F.col("left")) * F.col("k"), (F.col("y") + 0.5 - F.col("top")) * F.col("k")
    t, mw, mh = F.col("turns"), F.col("mw"), F.col("mh")
    u = F.when(t == 1, b).when(t == 2, mw - a).when(t == 3, mw - b).otherwise(a) - 0.5
    v = F.when(t == 1, mh - a).when(t == 2, mh - b).when(t == 3, a).otherwise(b) - 0.5
    d = d.withColumns({"u": u, "vv": v})
    # one tap per row; outside the mask reads nothing
    taps = F.array(*[F.struct((F.floor("u") + i).alias("tx"), (F.floor("vv") + j).alias("ty"), F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
    keys = ["image_id", "ord", "y", "x", "color", "u", "vv"]
    e = d.select("signature_id", *keys, F.explode(taps).alias("t")).select("signature_id", *keys, "t.*")
    m = masks.select("signature_id", F.col("mx").alias("tx"), F.col("my").alias("ty"), F.col("v").alias("m"))
    e = e.join(m, ["signature_id", "tx", "ty"])
    at = {(i, j): F.coalesce(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("m"))), F.lit(0)) for j in (0, 1) for i in (0, 1)}
    g = e.groupBy(*keys).agg(*[c.alias(f"m{i}{j}") for (i, j), c in at.items()])
    fx, fy = F.col("u") - F.floor("u"), F.col("vv") - F.floor("vv")
    cover = (F.col("m00") * (1 - fx) + F.col("m10") * fx) * (1 - fy) + (F.col("m01") * (1 - fx) + F.col("m11") * fx) * fy
    alpha = (cover.cast("float") / F.lit(255).cast("float")).cast("float")
    return g.select("image_id", "ord", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "color", alpha.alias("alpha")).filter(F.col("alpha") > F.lit(0.004).cast("float"))


def draw_stamps(px: DataFrame, coverage: DataFrame, bilevel: bool = False) -> DataFrame:
    """Gray pages with their signatures blended in, in stamp order."""
    ink = coverage.select("image_id", "y", "x", F.struct("ord", "alpha", ST.ink_luma(F.col("color")).alias("ink")).alias("s"))
    per_px = ink.groupBy("image_id", "y", "x").agg(F.sort_array(F.collect_list("s")).alias("_s"))  # one entry per stamp over a pixel
    d = px.join(per_px, ["image_id", "y", "x"], "left")
    if bilevel:
        v = F.when(F.exists("_s", lambda s: s["alpha"] >= 0.5), 0).otherwise(F.col("v"))
    else:
        v = F.aggregate("_s", F.col("v"), lambda acc, s: F.least(acc, ST.blend(acc, s["ink"], s["alpha"])))
    return d.withColumn("v", F.when(F.col("_s").isNull(), F.col("v")).otherwise(v)).drop("_s")
