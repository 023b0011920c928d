"""Pages of one row read at fractional positions: straightening with straight or curved sides, and resizing.

The numbers of a page (homography, side displacements' inputs) are columns; a page is read once
and by index, so nothing but the page row itself is moved. Conventions are those of
``resample``: pixel ``i`` is centred at ``i + 0.5``, outside the picture is paper.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.operators import scanlines as SL

PAPER = 255.0


def bilinear(p: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Levels between pixel centres; more than half a pixel outside the outermost centres is paper."""
    h, w = p.shape[:2]
    inside = (sx >= -0.5) & (sy >= -0.5) & (sx <= w - 0.5) & (sy <= h - 0.5)
    x, y = np.floor(np.where(inside, sx, 0)), np.floor(np.where(inside, sy, 0))
    fx, fy = np.where(x < 0, 0.0, sx - x), np.where(y < 0, 0.0, sy - y)
    x0, y0 = np.clip(x, 0, w - 1).astype(int), np.clip(y, 0, h - 1).astype(int)
    x1, y1 = np.clip(x + 1, 0, w - 1).astype(int), np.clip(y + 1, 0, h - 1).astype(int)
    x1, y1 = np.where(x < 0, x0, x1), np.where(y < 0, y0, y1)
    if p.ndim == 3:
        inside, fx, fy = inside[..., None], fx[..., None], fy[..., None]
    top = p[y0, x0] * (1 - fx) + p[y0, x1] * fx
    bottom = p[y1, x0] * (1 - fx) + p[y1, x1] * fx
    return np.where(inside, top * (1 - fy) + bottom * fy, PAPER)


def _through(m: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def side_shift(m: np.ndarray, quad: np.ndarray, side: int, bend: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    """How far the bulge of a side pushes outward the points that ``(x, y)`` on its border of the result come from."""
    a, along = quad[side], quad[(side + 1) % 4] - quad[side]
    length = float(np.hypot(*along))
    if length < 1e-9:
        return np.zeros_like(x + y), np.zeros_like(x + y)
    n = np.array([-along[1], along[0]]) / length
    if n @ (quad.mean(0) - a) > 0:
        n = -n
    sx, sy = _through(m, x, y)
    t = np.clip(((sx - a[0]) * along[0] + (sy - a[1]) * along[1]) / (along @ along), 0, 1)
    d = t * (1 - t) * (bend[0] + bend[1] * t) * length
    return n[0] * d, n[1] * d


def _displacement(m: np.ndarray, quad: np.ndarray, bends: np.ndarray, ow: int, oh: int) -> tuple[np.ndarray, np.ndarray]:
    """Shift of every result pixel, blended from the four sides by its distance to them."""
    x, y = np.arange(ow) + 0.5, np.arange(oh) + 0.5
    u, v = x / ow, (y / oh)[:, None]
    b = bends.reshape(4, 2)
    top, bottom = side_shift(m, quad, 0, b[0], x, 0.0), side_shift(m, quad, 2, b[2], x, float(oh))
    left, right = side_shift(m, quad, 3, b[3], 0.0, y), side_shift(m, quad, 1, b[1], float(ow), y)
    return tuple((1 - v) * top[k] + v * bottom[k] + (1 - u) * left[k][:, None] + u * right[k][:, None] for k in (0, 1))


def _warped(p: np.ndarray, at: dict) -> np.ndarray:
    ow, oh, m = at["ow"], at["oh"], np.array(at["m"])
    x, y = np.arange(ow), np.arange(oh)[:, None]
    shift = _displacement(m, np.array(at["quad"]).reshape(4, 2), np.array(at["bends"]), ow, oh) if at["bends"] and any(at["bends"]) else (0.0, 0.0)
    steps = (0.25, 0.75) if at["dense"] else (0.5,)
    total = 0.0
    for dy in steps:
        for dx in steps:
            sx, sy = _through(m, x + dx, y + dy)
            total = total + bilinear(p, sx - 0.5 + shift[0], sy - 0.5 + shift[1])
    return np.floor(total / len(steps) ** 2 + 0.5)


def warp(pages: DataFrame, quad: Column, ow: Column, oh: Column, bends: Column | None = None, planes: int = 1) -> DataFrame:
    """Every page with its outline ``quad`` straightened into ``ow x oh``; pages without a homography are left out.

    With ``bends`` (two numbers a side, null or zero when flat) the curved sides land on the
    borders of the result and the paper between them is stretched along. A source much denser
    than the result is read at 2 x 2 positions.
    """
    d = pages.withColumns({"_q": quad, "ow": ow.cast("int"), "oh": oh.cast("int"), "_b": F.lit(None).cast("array<double>") if bends is None else bends})
    q = F.col("_q")
    p = G.corners(q)
    ratio = (G.dist(p[0], p[1]) / F.col("ow") + G.dist(p[0], p[3]) / F.col("oh")) / 2
    d = d.withColumn("_m", G.homography(q, F.col("ow"), F.col("oh"))).filter(F.col("_m").isNotNull())
    at = F.struct("ow", "oh", F.col("_m").alias("m"), q.alias("quad"), F.col("_b").alias("bends"), (ratio > 1.25).alias("dense"))
    d = d.withColumn("vals", SL.of(SL.per_page(_warped, SL.BYTES, planes), at))
    return d.withColumns({"w": F.col("ow"), "h": F.col("oh")}).drop("_q", "_b", "_m", "ow", "oh")


def _resized(p: np.ndarray, to: dict) -> np.ndarray:
    f = max(1, min(p.shape[1] // to["ow"], p.shape[0] // to["oh"]))
    small = SL._shrunk(p, f)
    h, w = small.shape[:2]
    sx = np.maximum((np.arange(to["ow"]) + 0.5) * (w / to["ow"]) - 0.5, 0.0)
    sy = np.maximum((np.arange(to["oh"]) + 0.5) * (h / to["oh"]) - 0.5, 0.0)[:, None]
    return np.floor(bilinear(small, *np.broadcast_arrays(sx, sy)) + 0.5)


def resize(pages: DataFrame, ow: Column, oh: Column, planes: int = 1) -> DataFrame:
    """Exactly ``ow x oh``: a box shrink to within twice the size, then bilinear."""
    d = pages.withColumns({"_ow": ow.cast("int"), "_oh": oh.cast("int")})
    d = d.withColumn("vals", SL.of(SL.per_page(_resized, SL.BYTES, planes), F.struct(F.col("_ow").alias("ow"), F.col("_oh").alias("oh"))))
    return d.withColumns({"w": F.col("_ow"), "h": F.col("_oh")}).drop("_ow", "_oh")
