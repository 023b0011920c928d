"""Reading images at fractional positions: resize, warp, levelling, background division.

Each source pixel first gets its right, lower and diagonal neighbour (windows on the image
partitioning), so an output pixel needs one equi-join on its upper-left tap instead of four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions.arith import clamp
from folio.operators import raster as R

PAPER = 255


def blocks(px: DataFrame, *values: str) -> DataFrame:
    """Adds ``{c}_x, {c}_y, {c}_xy``: right, lower and diagonal neighbour, the edge repeated."""
    values = values or ("v",)
    d = px.withColumns({f"{c}_x": F.coalesce(F.lead(c).over(R.along_rows()), F.col(c)) for c in values})
    return d.withColumns({f"{c}_y{s}": F.coalesce(F.lead(f"{c}{u}").over(R.along_cols()), F.col(f"{c}{u}"))
                          for c in values for s, u in (("", ""), ("x", "_x"))}).withColumnsRenamed({f"{c}_yx": f"{c}_xy" for c in values})


def lerp2(c: str, fx: Column, fy: Column) -> Column:
    top = F.col(c) * (1 - fx) + F.col(f"{c}_x") * fx
    bottom = F.col(f"{c}_y") * (1 - fx) + F.col(f"{c}_xy") * fx
    return top * (1 - fy) + bottom * fy


def read_at(px: DataFrame, pos: DataFrame, *values: str) -> DataFrame:
    """``pos`` (``image_id, y, x, sx, sy, inside, w, h`` of the output) with rounded bilinear levels.

    ``sx, sy`` are positions between pixel centres; outside positions read paper.
    """
    values = values or ("v",)
    src = blocks(px.select("image_id", "w", "h", "y", "x", *values), *values)
    taps = [x for c in values for x in (c, f"{c}_x", f"{c}_y", f"{c}_xy")]
    src = src.select(F.col("image_id").alias("_i"), F.col("y").alias("_sy"), F.col("x").alias("_sx"), *taps)
    d = pos.withColumns({"_x0": F.greatest(F.floor("sx"), F.lit(0)).cast("int"), "_y0": F.greatest(F.floor("sy"), F.lit(0)).cast("int")})
    d = d.withColumns({"_fx": clamp(F.col("sx") - F.col("_x0"), 0.0, 1.0), "_fy": clamp(F.col("sy") - F.col("_y0"), 0.0, 1.0)})
    d = d.join(src, (F.col("image_id") == F.col("_i")) & (F.col("_y0") == F.col("_sy")) & (F.col("_x0") == F.col("_sx")), "left")
    out = {c: F.when(F.col("inside") & F.col(c).isNotNull(), F.floor(lerp2(c, F.col("_fx"), F.col("_fy")) + 0.5)).otherwise(PAPER).cast("int") for c in values}
    return d.withColumns(out).drop("_i", "_sx", "_sy", "_x0", "_y0", "_fx", "_fy", "sx", "sy", "inside",
                                   *[t for t in taps if t not in values])


def grid(images: DataFrame, w: Column, h: Column) -> DataFrame:
    """One row per output pixel: the images' columns with ``y, x`` and the new size ``ow, oh``."""
    d = images.withColumns({"ow": w.cast("int"), "oh": h.cast("int")})
    return d.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("oh") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("ow") - 1)))


def resize(px: DataFrame, images: DataFrame, ow: Column, oh: Column, *values: str) -> DataFrame:
    """Exactly ``ow x oh`` per image: a box shrink to within twice the size, then bilinear."""
    values = values or ("v",)
    f = F.greatest(F.lit(1), F.least(F.floor(F.col("w") / ow), F.floor(F.col("h") / oh))).cast("int")
    small = R.box_downscale(px, f, *values)
    d = grid(images.withColumn("_f", f), ow, oh)
    sw, sh = F.greatest(F.lit(1), F.floor(F.col("w") / F.col("_f"))), F.greatest(F.lit(1), F.floor(F.col("h") / F.col("_f")))
    kx, ky = sw.cast("double") / F.col("ow"), sh.cast("double") / F.col("oh")
    pos = d.select("image_id", F.col("ow").alias("w"), F.col("oh").alias("h"), "y", "x",
                   F.greatest((F.col("x") + 0.5) * kx - 0.5, F.lit(0.0)).alias("sx"),
                   F.greatest((F.col("y") + 0.5) * ky - 0.5, F.lit(0.0)).alias("sy"), F.lit(True).alias("inside"))
    return read_at(small, pos, *values)


def warp(px: DataFrame, images: DataFrame, quad: Column, ow: Column, oh: Column, *values: str) -> DataFrame:
    """The outline ``quad`` (source pixels) straightened into ``ow x oh``; outside the picture is paper.

    Pixel-edge convention; a source much denser than the output is read at 2 x 2 sub-positions.
    """
    values = values or ("v",)
    d = images.withColumns({"_q": quad, "ow": ow.cast("int"), "oh": oh.cast("int"), "_sw": F.col("w"), "_sh": F.col("h")})
    q = F.col("_q")
    d = d.withColumn("_m", G.homography(q, F.col("ow"), F.col("oh")))
    p = G.corners(q)
    ratio = (G.dist(p[0], p[1]) / F.col("ow") + G.dist(p[0], p[3]) / F.col("oh")) / 2
    one = F.array(F.struct(F.lit(0.5).alias("dx"), F.lit(0.5).alias("dy")))
    four = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for b in (0.25, 0.75) for a in (0.25, 0.75)])
    d = grid(d.withColumn("_sub", F.when(ratio > 1.25, four).otherwise(one)), F.col("ow"), F.col("oh"))
    d = d.withColumn("_s", F.explode("_sub"))
    sx, sy = G.homography_apply(F.col("_m"), F.col("x") + F.col("_s.dx"), F.col("y") + F.col("_s.dy"))
    d = d.withColumns({"sx": sx - 0.5, "sy": sy - 0.5})
    inside = (F.col("sx") >= -0.5) & (F.col("sy") >= -0.5) & (F.col("sx") <= F.col("_sw") - 0.5) & (F.col("sy") <= F.col("_sh") - 0.5)
    pos = d.select("image_id", F.col("ow").alias("w"), F.col("oh").alias("h"), "y", "x", "sx", "sy", inside.alias("inside"))
    return _averaged(px, pos, values)


def _averaged(px: DataFrame, pos: DataFrame, values) -> DataFrame:
    """Bilinear reads averaged over the sub-positions of an output pixel, rounded once."""
    src = blocks(px.select("image_id", "w", "h", "y", "x", *values), *values)
    taps = [x for c in values for x in (c, f"{c}_x", f"{c}_y", f"{c}_xy")]
    src = src.select(F.col("image_id").alias("_i"), F.col("y").alias("_sy"), F.col("x").alias("_sx"), *taps)
    d = pos.withColumns({"_x0": F.greatest(F.floor("sx"), F.lit(0)).cast("int"), "_y0": F.greatest(F.floor("sy"), F.lit(0)).cast("int")})
    # left of the first pixel centre both taps are the first pixel
    d = d.withColumns({"_fx": F.when(F.col("sx") < 0, 0.0).otherwise(F.col("sx") - F.col("_x0")), "_fy": F.when(F.col("sy") < 0, 0.0).otherwise(F.col("sy") - F.col("_y0"))})
    d = d.join(src, (F.col("image_id") == F.col("_i")) & (F.col("_y0") == F.col("_sy")) & (F.col("_x0") == F.col("_sx")), "left")
    level = {c: F.when(F.col("inside") & F.col(c).isNotNull(), lerp2(c, F.col("_fx"), F.col("_fy"))).otherwise(255.0) for c in values}
    return d.groupBy("image_id", "w", "h", "y", "x").agg(*[F.floor(F.avg(e) + 0.5).cast("int").alias(c) for c, e in level.items()])


def level_rows(px: DataFrame, tilts: DataFrame, *values: str) -> DataFrame:
    """Every row turned back by the lean at its height (``angle + slope * (v - 0.5)``); paper outside.

    ``tilts``: ``image_id, w, h, angle, slope``; images without a lean are not in it and stay as they are.
    """
    values = values or ("v",)
    d = grid(tilts, F.col("w"), F.col("h"))
    a = F.radians(F.col("angle") + F.col("slope") * ((F.col("y") + 0.5) / F.col("h") - 0.5))
    cx, cy = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    dx, dy = F.col("x") - cx, F.col("y") - cy
    d = d.withColumns({"sx": cx + dx * F.cos(a) - dy * F.sin(a), "sy": cy + dx * F.sin(a) + dy * F.cos(a)})
    inside = (F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") <= F.col("w") - 1) & (F.col("sy") <= F.col("h") - 1)
    turned = read_at(px, d.select("image_id", "w", "h", "y", "x", "sx", "sy", inside.alias("inside")), *values)
    rest = px.join(tilts.select("image_id"), "image_id", "left_anti").select("image_id", "w", "h", "y", "x", *values)
    return turned.select("image_id", "w", "h", "y", "x", *values).unionByName(rest)


# --- even lighting -----------------------------------------------------------------

RADII = (2, 3, 4, 5, 6)  # a background estimate of at most 256 pixels has one of these radii
ESTIMATE_EDGE = 256


def background(px: DataFrame) -> DataFrame:
    """Paper brightness on a small copy: local maximum, blur, floor. Adds ``f``, the shrink factor."""
    f = F.greatest(F.lit(1), F.ceil(F.greatest("w", "h") / ESTIMATE_EDGE)).cast("int")
    small = R.box_downscale(px, f, keep="f")
    level = R.percentile_level(R.histogram(small), 0.95, "level")
    r = F.greatest(F.lit(2), F.floor(F.greatest("w", "h") / 40)).cast("int")
    s = small.withColumn("r", r)
    s = R.box_blur(R.max_filter(s, F.col("r"), RADII), F.col("r"), RADII)
    s = s.join(level, "image_id")
    low = F.greatest(F.lit(1), F.floor(F.col("level") * F.lit(0.3))).cast("int")
    return s.withColumn("v", F.greatest(F.col("v"), low)).drop("r", "level")


def flatten_background(px: DataFrame) -> DataFrame:
    """Every pixel divided by the paper brightness at its place: even white paper, ink kept."""
    bg = blocks(background(px)).select(
        F.col("image_id").alias("_i"), F.col("y").alias("_sy"), F.col("x").alias("_sx"), "f",
        *[F.col(c).cast("float").alias(f"b{c[1:]}") for c in ("v", "v_x", "v_y", "v_xy")])
    size = px.select("image_id", F.greatest(F.lit(1), F.ceil(F.greatest("w", "h") / ESTIMATE_EDGE)).cast("int").alias("_f"), "w", "h", "y", "x", "v")
    sx, sy = (F.col("x") + 0.5) / F.col("_f") - 0.5, (F.col("y") + 0.5) / F.col("_f") - 0.5
    sw, sh = F.greatest(F.lit(1), F.floor(F.col("w") / F.col("_f"))), F.greatest(F.lit(1), F.floor(F.col("h") / F.col("_f")))
    d = size.withColumns({"_x0": F.least(F.greatest(F.floor(sx), F.lit(0)), sw - 1).cast("int"), "_y0": F.least(F.greatest(F.floor(sy), F.lit(0)), sh - 1).cast("int")})
    d = d.withColumns({"_fx": clamp(sx - F.col("_x0"), 0.0, 1.0).cast("float"), "_fy": clamp(sy - F.col("_y0"), 0.0, 1.0).cast("float")})
    d = d.join(bg, (F.col("image_id") == F.col("_i")) & (F.col("_y0") == F.col("_sy")) & (F.col("_x0") == F.col("_sx")))
    one = F.lit(1).cast("float")
    fx, fy = F.col("_fx"), F.col("_fy")
    top = F.col("b") * (one - fx) + F.col("b_x") * fx
    bottom = F.col("b_y") * (one - fx) + F.col("b_xy") * fx
    paper = F.greatest(one, top * (one - fy) + bottom * fy)
    v = F.least(F.lit(255), F.floor(F.col("v").cast("float") * F.lit(255).cast("float") / paper + F.lit(0.5).cast("float")).cast("int"))
    return d.select("image_id", "w", "h", "y", "x", v.alias("v"))
