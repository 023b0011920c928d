"""How far text leans, on pages of one row (see ``scanlines``): the rules of ``projection`` without a row per ink pixel.

A page's ink never leaves the page row: profiles of all candidate angles are counted where the
page is, and what leaves is a score per angle or a row per band.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import settings as S
from folio.operators import projection as PR
from folio.operators import sampling as SM
from folio.operators import scanlines as SL

COARSE = 61            # half degrees from -15 to 15
AT_ONCE = 1 << 20      # bins held at a time while many angles are counted


def _otsu(counts: np.ndarray) -> int:
    """``raster.otsu`` of one histogram: only levels that occur, the lowest on ties, 128 where there is one level."""
    v = np.flatnonzero(counts)
    n = counts[v].astype(np.float64)
    wb, sb = np.cumsum(n)[:-1], np.cumsum(v * n)[:-1]
    if not len(wb):
        return 128
    wf, above = n.sum() - wb, (v * n).sum() - sb
    gap = sb / wb - above / wf
    return int(v[np.argmax(wb * wf * gap * gap)])


def _ink(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``y, x`` of the ink away from the rim; none where there is too little or too much of it."""
    h, w = p.shape
    mx, my = w * 3 // 100, h * 3 // 100
    y, x = np.nonzero(p[my:h - my, mx:w - mx] <= _otsu(SL._histogram(p)))
    return (y + my, x + mx) if 200 <= len(y) <= w * h // 2 else (y[:0], x[:0])


def _steps(bins: np.ndarray, ends: bool) -> np.ndarray:
    """Sums of squared differences of neighbouring bins for each row of ``bins`` (from 0); with ``ends`` also those at both ends."""
    k, size = len(bins), int(bins.max()) + 1
    n = np.bincount((bins + (np.arange(k) * size)[:, None]).ravel(), minlength=k * size).reshape(k, size)
    steps = np.diff(n, axis=1)
    total = (steps * steps).sum(1)
    return total + n[:, 0] ** 2 + n[:, -1] ** 2 if ends else total


def _page_scores(y: np.ndarray, x: np.ndarray, angles: list[float]) -> list[int]:
    """Score of a page's ink at each angle."""
    out, at = [], max(1, AT_ONCE // len(y))
    for i in range(0, len(angles), at):
        a = [v * math.pi / 180 for v in angles[i:i + at]]
        cos, sin = (np.array([f(v) for v in a])[:, None] for f in (math.cos, math.sin))
        bins = np.rint(y * cos - x * sin).astype(np.int64)
        out += _steps(bins - bins.min(1, keepdims=True), True).tolist()
    return out


def _angles(start: float, step: float, n: int) -> list[float]:
    return [start + k * step for k in range(n)]


def _coarse(p: np.ndarray) -> list[int] | None:
    y, x = _ink(p)
    return _page_scores(y, x, _angles(-15.0, 0.5, COARSE)) if len(y) else None


coarse_of = SL.per_page(_coarse, SL.LONGS)
ink_count_of = SL.per_page(lambda p: len(_ink(p)[0]), T.LongType())


def angle(k: Column) -> Column:
    return F.lit(-15.0) + k * F.lit(0.5)


def projection_scores(pages: DataFrame) -> DataFrame:
    """``image_id, angle, score`` at each coarse angle, of pages with enough ink."""
    d = SL.shrink(pages, S.factor_for(100)).filter("h > 0").select("image_id", F.posexplode(SL.of(coarse_of)).alias("k", "score"))
    return d.select("image_id", angle(F.col("k")).alias("angle"), "score")


def ink_by_angle(pages: DataFrame) -> DataFrame:
    """``image_id, angle, points``: ink counted at each coarse angle, of pages with enough of it."""
    d = SL.shrink(pages, S.factor_for(100)).filter("h > 0").select("image_id", SL.of(ink_count_of).alias("points")).filter("points > 0")
    return d.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(COARSE - 1))).alias("k"), "points").select("image_id", angle(F.col("k")).alias("angle"), "points")


def _sharpest(p: np.ndarray, max_angle: float) -> dict | None:
    """Coarse angles in steps of half a degree, then twentieths around the best; the smaller angle wins ties."""
    y, x = _ink(p)
    if not len(y):
        return None
    angles = _angles(-max_angle, 0.5, round(4 * max_angle) + 1)
    scores = _page_scores(y, x, angles)
    best = max(range(len(angles)), key=lambda i: (scores[i], -angles[i]))
    fine = _angles(angles[best] - 0.5, 0.05, 21)
    finer = _page_scores(y, x, fine)
    top = max(range(21), key=lambda i: (finer[i], -fine[i]))
    won = (fine[top], finer[top]) if finer[top] > scores[best] else (angles[best], scores[best])
    return {"best": won[0], "best_score": won[1], "zero": next((s for s, a in zip(scores, angles) if a == 0), 0)}


sharpest_of = SL.per_page(_sharpest, SL.record(best=T.DoubleType(), best_score=T.LongType(), zero=T.LongType()))


def page_skew(pages: DataFrame, dpi: int = 100, max_angle: float = 15.0) -> DataFrame:
    """``pages`` with ``skew`` in degrees, 0 without a confident estimate."""
    f = S.factor_for(dpi)
    small = pages.withColumns({"_sw": F.floor(F.col("w") / f).cast("int"), "_sh": F.floor(F.col("h") / f).cast("int")})
    shrunk = SL.of(SL.shrunk_of, f) if f > 1 else F.col("vals")
    d = small.withColumn("_m", sharpest_of(F.when((F.col("_sw") > 0) & (F.col("_sh") > 0), shrunk), F.col("_sw"), F.col("_sh"), F.lit(float(max_angle))))
    sure = (F.col("_m.best_score") >= F.col("_m.zero") * F.lit(1.05)) & (F.abs("_m.best") >= 0.1)
    return d.withColumn("skew", F.when(sure, F.col("_m.best")).otherwise(0.0)).drop("_m", "_sw", "_sh")


# --- lean of text lines ------------------------------------------------------------

def _band(y: np.ndarray, x: np.ndarray, w: int) -> dict | None:
    """Sharpest lean of a band's ink; of equal ones the smallest."""
    low, high = int(y.min()), int(y.max())
    span = high - low + math.floor(w * math.tan(PR.MAX_LEAN * math.pi / 180)) + 4
    off = -low + span // 2 - (high - low) // 2

    def scores(angles: list[float]) -> list[int]:
        out, at = [], max(1, AT_ONCE // len(y))
        for i in range(0, len(angles), at):
            tan = np.array([math.tan(a * math.pi / 180) for a in angles[i:i + at]])[:, None]
            bins = np.rint(y - tan * (x - w / 2)).astype(np.int64) + off
            # what falls outside is counted in two bins of its own, which take no part
            bins = np.where((bins < 0) | (bins >= span + 2), span + 2, bins)
            n = np.bincount((bins + (np.arange(len(bins)) * (span + 3))[:, None]).ravel(), minlength=len(bins) * (span + 3)).reshape(len(bins), span + 3)
            steps = np.diff(n[:, :span + 2], axis=1)
            out += (steps * steps).sum(1).tolist()
        return out

    angles = _angles(-PR.MAX_LEAN, 0.25, 65)
    coarse = scores(angles)
    best = max(range(65), key=lambda i: (coarse[i], -angles[i]))
    fine = _angles(angles[best] - 0.25, 0.025, 21)
    finer = scores(fine)
    top = max(range(21), key=lambda i: (finer[i], -fine[i]))
    a, s = (fine[top], finer[top]) if finer[top] > coarse[best] else (angles[best], coarse[best])
    worst = min(coarse)
    return {"angle": a, "contrast": s / worst if worst > 0 else 1.0} if s > 0 else None


def _bands(p: np.ndarray) -> list[dict]:
    """Lean of the four bands of a page, for lines across it and (transposed) down it."""
    window = min(max(max(p.shape) // 40 | 1, 15), 61)
    ink = p <= SL._threshold(*SL._stats(p, window), S.SAUVOLA_K, 0.0)
    out = []
    for name, page in (("rows", ink), ("cols", ink.T)):
        h, w = page.shape
        mx, my = w * 5 // 100, h * 4 // 100
        bh = (h - 2 * my) // PR.BANDS
        for band in range(PR.BANDS):
            y0 = my + band * bh
            y, x = np.nonzero(page[y0:y0 + bh, mx:w - mx])
            if 150 <= len(y) <= bh * (w - 2 * mx) * 0.45:
                found = _band(y + y0, x + mx, w)
                if found:
                    out.append({"dir": name, "band": band, **found, "n": len(y), "v": (y0 + y0 + bh) / 2.0 / h})
    return out


bands_of = SL.per_page(_bands, T.ArrayType(SL.record(dir=T.StringType(), band=T.IntegerType(), angle=T.DoubleType(), contrast=T.DoubleType(), n=T.LongType(), v=T.DoubleType())))


def band_angles(pages: DataFrame, long_edge: int = PR.LONG_EDGE) -> DataFrame:
    """``image_id, dir, band, angle, contrast, n, v`` of each measured band, on pages shrunk to ``long_edge``; shorter ones as they are."""
    longest = F.greatest("w", "h")
    side = lambda c: F.when(longest > long_edge, F.greatest(F.lit(1), F.floor(F.col(c) * (F.lit(float(long_edge)) / longest)))).otherwise(F.col(c)).cast("int")
    d = pages.withColumns({"_ow": side("w"), "_oh": side("h")}).filter((F.col("_ow") >= 64) & (F.col("_oh") >= 64))
    big = SM.resize(d.filter(longest > long_edge), F.col("_ow"), F.col("_oh"))
    keep = ["image_id", "w", "h", "vals"]
    small = d.filter(longest <= long_edge).select(*keep).unionByName(big.select(*keep))
    return small.select("image_id", F.explode(SL.of(bands_of)).alias("b")).select("image_id", "b.*")


def _levelled(p: np.ndarray, lean: dict | None) -> np.ndarray:
    if lean is None:
        return p
    h, w = p.shape
    cx, cy, y = (w - 1) / 2.0, (h - 1) / 2.0, np.arange(h)[:, None]
    a = np.radians(lean["angle"] + lean["slope"] * ((y + 0.5) / h - 0.5))
    dx, dy = np.arange(w) - cx, y - cy
    sx, sy = cx + dx * np.cos(a) - dy * np.sin(a), cy + dx * np.sin(a) + dy * np.cos(a)
    inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
    return np.where(inside, np.floor(SM.bilinear(p, sx, sy) + 0.5), SM.PAPER)


def level_rows(pages: DataFrame, tilts: DataFrame) -> DataFrame:
    """Every row turned back by the lean at its height; pages that are not in ``tilts`` (``image_id, angle, slope``) stay as they are."""
    t = tilts.select("image_id", F.struct("angle", "slope").alias("_t"))
    d = pages.join(t, "image_id", "left")
    return d.withColumn("vals", SL.of(SL.per_page(_levelled, SL.BYTES), F.col("_t"))).drop("_t")
