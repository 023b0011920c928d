"""Pixel operators on ``(image_id, w, h, y, x, v)``.

Inputs are expected to be hash-partitioned by ``image_id`` (see ``session.by_image``); every
window and aggregate below keys on the image first and so adds no exchange. Sliding sums are
running sums looked up at both ends of the window, so their cost does not grow with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
RUNNING = (Window.unboundedPreceding, Window.currentRow)
R_SAUVOLA = 128.0  # fixed value: dynamic range of the deviation of 8-bit input


def along_rows():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_cols():
    return Window.partitionBy("image_id", "x").orderBy("y")


def digest(v: Column | str = "v") -> list[Column]:
    """Whole-image checks of a result raster: count, sum and a position-weighted sum."""
    v = F.col(v) if isinstance(v, str) else v
    v = v.cast("bigint")
    return [F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"),
            F.sum(v * ((F.col("y") * 131 + F.col("x") * 17) % 1009)).alias("placed")]


# --- histograms --------------------------------------------------------------------

def histogram(px: DataFrame, *keys: str) -> DataFrame:
    """``image_id, v, n``; partial counts combine before any exchange."""
    return px.groupBy("image_id", *keys, "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """``image_id, threshold``: the level with the largest between-class variance, lowest on ties."""
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(*RUNNING)
    all_ = Window.partitionBy("image_id").orderBy("v").rowsBetween(*WHOLE)
    weighted = (F.col("v") * F.col("n"))
    h = (hist.withColumn("wb", F.sum("n").over(w)).withColumn("sb", F.sum(weighted).over(w))
         .withColumn("total", F.sum("n").over(all_)).withColumn("sum_all", F.sum(weighted).over(all_)))
    wf = F.col("total") - F.col("wb")
    gap = (F.col("sb").cast("double") / F.col("wb")
           - (F.col("sum_all").cast("double") - F.col("sb").cast("double")) / F.when(wf > 0, wf))
    between = F.col("wb").cast("double") * wf * gap * gap
    best = F.max(F.when(wf > 0, F.struct(between.alias("b"), (-F.col("v")).alias("o")))).alias("m")
    return h.groupBy("image_id").agg(best).select("image_id", F.coalesce(-F.col("m.o"), F.lit(128)).alias("threshold"))


def percentile_level(hist: DataFrame, p: float, name: str = "level") -> DataFrame:
    """First level whose running count reaches ``floor(n * p)``; 0 when that is 0, else 255 if never."""
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(*RUNNING)
    all_ = Window.partitionBy("image_id").orderBy("v").rowsBetween(*WHOLE)
    h = hist.withColumn("acc", F.sum("n").over(w)).withColumn("total", F.sum("n").over(all_))
    target = F.floor(F.col("total") * F.lit(float(p)))
    return h.groupBy("image_id").agg(
        F.coalesce(F.min(F.when(target == 0, 0).when(F.col("acc") >= target, F.col("v"))), F.lit(255)).alias(name))


def box_downscale(px: DataFrame, f: int | Column, *values: str, keep: str = "_f") -> DataFrame:
    """Integer box mean by ``f`` (a number, or a column constant per image); remainders are left out,
    and so are pictures smaller than one box.

    ``keep`` names a column to hold the factor in the result.
    """
    values = values or ("v",)
    if isinstance(f, int):
        if f <= 1:
            return px
        f = F.lit(f)
    d = px.withColumn("_f", f)
    f = F.col("_f")
    cell = d.withColumns({"w": F.floor(F.col("w") / f).cast("int"), "h": F.floor(F.col("h") / f).cast("int"),
                          "y": F.floor(F.col("y") / f).cast("int"), "x": F.floor(F.col("x") / f).cast("int")})
    cell = cell.filter((F.col("x") < F.col("w")) & (F.col("y") < F.col("h")))
    return cell.groupBy("image_id", "w", "h", "y", "x", "_f").agg(
        *[F.floor(F.sum(c) / (f * f)).cast("int").alias(c) for c in values]).withColumnRenamed("_f", keep).drop("_f")


# --- sliding windows ---------------------------------------------------------------

def _line_sum(df: DataFrame, over, half: int | Column, cols: dict[str, Column], halves=()) -> DataFrame:
    """Clipped sliding sums of ``cols`` along one axis, from running sums at both window ends.

    ``half`` may be a column constant per image out of a few possible ``halves``: the look-ups
    of every size share one sort.
    """
    run, last = over.rowsBetween(*RUNNING), over.rowsBetween(*WHOLE)
    for name, c in cols.items():
        df = df.withColumn(f"_{name}", F.sum(c).over(run))
    for name in cols:
        c = F.col(f"_{name}")
        ahead = _per_radius(half, halves, lambda k, c=c: F.lead(c, k).over(over))
        behind = _per_radius(half, halves, lambda k, c=c: F.lag(c, k + 1).over(over))
        df = df.withColumn(name, F.coalesce(ahead, F.last(c).over(last)) - F.coalesce(behind, F.lit(0)))
    return df.drop(*[f"_{n}" for n in cols])


def local_stats(px: DataFrame, window: int | Column, windows=()) -> DataFrame:
    """Adds ``mean, variance`` of the clipped ``window x window`` square around each pixel."""
    if isinstance(window, int):
        half, halves = max(0, window // 2), ()
    else:
        px = px.withColumn("_half", F.floor(window / 2).cast("int"))
        half, halves = F.col("_half"), tuple(k // 2 for k in windows)
    v = F.col("v").cast("bigint")
    d = _line_sum(px, along_rows(), half, {"s1": v, "s2": v * v}, halves)
    d = _line_sum(d, along_cols(), half, {"s1": F.col("s1"), "s2": F.col("s2")}, halves)
    nx = F.least(F.col("w") - 1, F.col("x") + half) - F.greatest(F.lit(0), F.col("x") - half) + 1
    ny = F.least(F.col("h") - 1, F.col("y") + half) - F.greatest(F.lit(0), F.col("y") - half) + 1
    n = (nx * ny).cast("double")
    mean = F.col("s1") / n
    return d.withColumn("mean", mean).withColumn(
        "variance", F.greatest(F.lit(0.0), F.col("s2") / n - F.col("mean") * F.col("mean"))).drop("s1", "s2", "_half")


def shade(v: Column, t: Column, ramp: float = 0.0) -> Column:
    """Level of ``v`` against threshold ``t``: hard, or with ``ramp`` gray levels of soft edge."""
    if ramp <= 0:
        return F.when(v <= t, 0).otherwise(255)
    o = F.lit(127.5) + (v - t) * F.lit(127.5 / ramp)
    return F.when(o <= 0, 0).when(o >= 255, 255).otherwise(F.floor(o)).cast("int")


def sauvola_threshold(mean: Column, dev: Column, k: float | Column, offset: float | Column = 0.0) -> Column:
    k, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (k, offset))
    return (mean + b) * (F.lit(1.0) + k * (dev / R_SAUVOLA - 1)) - b


def sauvola(px: DataFrame, window: int | Column, k: float = 0.34, offset: float = 0.0, ramp: float = 0.0, windows=()) -> DataFrame:
    """Adaptive threshold: ``v`` becomes ink (0) or paper (255), or a soft edge with ``ramp``."""
    s = local_stats(px, window, windows)
    t = sauvola_threshold(F.col("mean"), F.sqrt("variance"), k, offset)
    return s.withColumn("v", shade(F.col("v"), t, ramp)).drop("mean", "variance")


def _per_radius(r: int | Column, radii, make) -> Column:
    """``make(radius)``, or the one matching a per-image radius column out of the possible ones; any other radius is an error."""
    if isinstance(r, int):
        return make(r)
    out = F.when(r == radii[0], make(radii[0]))
    for k in radii[1:]:
        out = out.when(r == k, make(k))
    return out.when(r.isNotNull(), F.raise_error(F.concat(F.lit("window or radius not in the list of the job: "), r.cast("string"))))


def max_filter(px: DataFrame, r: int | Column, radii=()) -> DataFrame:
    """Square maximum, one axis after the other."""
    d = px.withColumn("v", _per_radius(r, radii, lambda k: F.max("v").over(along_rows().rowsBetween(-k, k))))
    return d.withColumn("v", _per_radius(r, radii, lambda k: F.max("v").over(along_cols().rowsBetween(-k, k))))


def box_blur(px: DataFrame, r: int | Column, radii=()) -> DataFrame:
    """Square mean with clipped borders; each pass truncates to whole levels."""
    d = px
    for over, pos, size in ((along_rows(), "x", "w"), (along_cols(), "y", "h")):
        if isinstance(r, int):
            d = _line_sum(d, over, r, {"s1": F.col("v").cast("bigint")})
        else:
            d = d.withColumn("s1", _per_radius(r, radii, lambda k, o=over: F.sum("v").over(o.rowsBetween(-k, k))))
        n = F.least(F.col(size) - 1, F.col(pos) + r) - F.greatest(F.lit(0), F.col(pos) - r) + 1
        d = d.withColumn("v", F.floor(F.col("s1") / n).cast("int")).drop("s1")
    return d


def _replicated_box(px: DataFrame, over, r: int) -> DataFrame:
    """Rounded mean of ``2r + 1`` neighbours, the edge pixel repeated outside."""
    n = 2 * r + 1
    first = F.first("v").over(over.rowsBetween(*WHOLE))
    last = F.last("v").over(over.rowsBetween(*WHOLE))
    taps = [F.col("v")]
    for i in range(1, r + 1):
        taps += [F.coalesce(F.lag("v", i).over(over), first), F.coalesce(F.lead("v", i).over(over), last)]
    total = taps[0]
    for t in taps[1:]:
        total = total + t
    return px.withColumn("v", F.floor((total + n // 2) / n).cast("int"))


def unsharp(px: DataFrame, r: int, amount: float = 0.8) -> DataFrame:
    """``v + amount * (v - blur)``; the blur is two rounds of a replicated box, in 32-bit arithmetic."""
    if r < 1:
        return px
    d = px.withColumn("v0", F.col("v"))
    for over in (along_rows(), along_cols(), along_rows(), along_cols()):
        d = _replicated_box(d, over, r)
    out = (F.col("v0").cast("float") + (F.lit(amount).cast("float") * (F.col("v0") - F.col("v")).cast("float")).cast("float")).cast("float")
    v = F.when(out <= 0, 0).when(out >= 255, 255).otherwise(F.floor((out + F.lit(0.5).cast("float")).cast("float")))
    return d.withColumn("v", v.cast("int")).drop("v0")


def shifted(over, c: str, k: int) -> Column:
    """Neighbour ``k`` steps along the axis, the edge pixel repeated outside."""
    if k == 0:
        return F.col(c)
    edge = F.first(c).over(over.rowsBetween(*WHOLE)) if k < 0 else F.last(c).over(over.rowsBetween(*WHOLE))
    return F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(over), edge)


def binomial_blur(px: DataFrame, *cols: str) -> DataFrame:
    """1-4-6-4-1 along rows, then columns, edge pixels repeated; levels in exact 256ths."""
    cols = cols or ("v",)
    d = px
    for over in (along_rows(), along_cols()):
        d = d.withColumns({c: shifted(over, c, -2) + shifted(over, c, 2) + 4 * (shifted(over, c, -1) + shifted(over, c, 1)) + 6 * F.col(c)
                           for c in cols})
    return d


def integral(px: DataFrame, c: str = "v") -> DataFrame:
    """Summed-area value per pixel (``total`` of everything up and left, inclusive)."""
    d = px.withColumn("total", F.sum(F.col(c).cast("bigint")).over(along_rows().rowsBetween(*RUNNING)))
    return d.withColumn("total", F.sum("total").over(along_cols().rowsBetween(*RUNNING)))


# --- pixels moved around -----------------------------------------------------------

def quarter_turn(px: DataFrame, turns: int) -> DataFrame:
    """Clockwise quarter turns, a projection of the coordinates."""
    turns %= 4
    w, h, x, y = (F.col(c) for c in "whxy")
    nx, ny = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns]
    nw, nh = (w, h) if turns % 2 == 0 else (h, w)
    return px.withColumns({"x": nx, "y": ny, "w": nw, "h": nh})


def crop(px: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Pixels of ``[x0, x1) x [y0, y1)``, shifted to the new origin."""
    keep = px.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return keep.withColumns({"x": (F.col("x") - x0).cast("int"), "y": (F.col("y") - y0).cast("int"),
                             "w": (x1 - x0).cast("int"), "h": (y1 - y0).cast("int")})


def book_halves(px: DataFrame, margin: float = 0.08) -> DataFrame:
    """Two page images per spread, each keeping ``margin`` of the width past the middle."""
    left_end = F.floor(F.col("w") * F.lit(0.5 + margin)).cast("int")
    right_start = F.floor(F.col("w") * F.lit(0.5 - margin)).cast("int")
    d = px.withColumns({"_l": left_end, "_r": right_start})
    halves = F.array(F.struct(F.lit("left").alias("half"), F.lit(0).alias("x0"), F.col("_l").alias("hw")),
                     F.struct(F.lit("right").alias("half"), F.col("_r").alias("x0"), (F.col("w") - F.col("_r")).alias("hw")))
    d = d.withColumn("_h", F.explode(halves)).filter((F.col("x") >= F.col("_h.x0")) & (F.col("x") < F.col("_h.x0") + F.col("_h.hw")))
    return d.withColumns({"half": F.col("_h.half"), "x": F.col("x") - F.col("_h.x0"), "w": F.col("_h.hw")}).drop("_h", "_l", "_r")


# --- connected ink -----------------------------------------------------------------

_NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _spread(ink: DataFrame, *carry: str) -> DataFrame:
    """Each ink pixel tells itself and its 8 neighbours what it carries (no join, no exchange)."""
    cells = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"),
                               F.lit(dy == 0 and dx == 0).alias("own")) for dy, dx in _NEAR])
    keep = [c for c in ink.columns if c not in ("y", "x")]
    return ink.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.y", "c.x", "c.own")


def small_components(ink: DataFrame, max_area: int) -> DataFrame:
    """``image_id, y, x, label`` of ink pixels in 8-connected pieces of at most ``max_area``.

    Exact with a fixed number of rounds: in a piece that small every pixel is within
    ``max_area - 1`` steps of every other, so after that many rounds of taking the smallest
    label around, its pixels agree. A label group is a whole piece exactly when no member
    touches another label.
    """
    d = ink.select("image_id", "y", "x", (F.col("y").cast("bigint") * 1048576 + F.col("x")).alias("label"))
    for _ in range(max_area - 1):
        d = (_spread(d).groupBy("image_id", "y", "x")
             .agg(F.min("label").alias("label"), F.bool_or("own").alias("own")).filter("own").drop("own"))
    d = (_spread(d).groupBy("image_id", "y", "x")
         .agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
              F.max(F.when(F.col("own"), F.col("label"))).alias("label"))
         .filter("label IS NOT NULL"))
    group = Window.partitionBy("image_id", "label")
    d = (d.withColumn("size", F.count(F.lit(1)).over(group))
         .withColumn("closed", F.min((F.col("lo") == F.col("hi"))).over(group)))
    return d.filter(F.col("closed") & (F.col("size") <= max_area)).select("image_id", "y", "x", "label")


def despeckled_ink(ink: DataFrame, max_area: int) -> DataFrame:
    """Ink pixels left after small pieces are removed."""
    d = ink.select("image_id", "y", "x")
    return d.join(small_components(d, max_area), ["image_id", "y", "x"], "left_anti")


def ink_after_specks(ink: DataFrame, max_area: int, *keys: str) -> DataFrame:
    """``image_id, ink, specks``: counts after removal, without going back to the pixels."""
    d = ink.select("image_id", "y", "x", (F.col("y").cast("bigint") * 1048576 + F.col("x")).alias("label"))
    for _ in range(max_area - 1):
        d = (_spread(d).groupBy("image_id", "y", "x")
             .agg(F.min("label").alias("label"), F.bool_or("own").alias("own")).filter("own").drop("own"))
    d = (_spread(d).groupBy("image_id", "y", "x")
         .agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
              F.max(F.when(F.col("own"), F.col("label"))).alias("label"))
         .filter("label IS NOT NULL"))
    groups = d.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("size"),
                                                F.min(F.col("lo") == F.col("hi")).alias("closed"))
    speck = F.col("closed") & (F.col("size") <= max_area)
    return groups.groupBy("image_id").agg(
        F.sum(F.when(speck, 0).otherwise(F.col("size"))).alias("ink"),
        F.count_if(speck).alias("specks"))
