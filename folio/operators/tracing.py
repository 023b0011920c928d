"""Edges, lines and side counts of pictures that are one row each: ``image_id, w, h, vals`` (three bytes a pixel).

The same steps as ``edges`` and ``support`` take on a row per pixel, as small array functions on
the picture row: what leaves a picture are its edge pixels, its lines and the scores of
outlines, so no pixel, vote or probe becomes a row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import edges as E
from folio.operators import scanlines as SL

INTS = T.ArrayType(T.IntegerType())
EDGES = SL.record(at=INTS, theta=SL.DOUBLES, mag=SL.DOUBLES)


def pictures(rgb: DataFrame) -> DataFrame:
    """``image_id, w, h, vals`` of pictures given as a row per pixel (``y, x, r, g, b``)."""
    def placed(w, h, px):
        p = np.zeros((h, w, 3), np.uint8)
        p[px["y"], px["x"]] = np.stack([px[c] for c in "rgb"], -1)
        return p.tobytes()

    whole = rgb.groupBy("image_id", "w", "h").agg(F.collect_list(F.struct("y", "x", *"rgb")).alias("px"))
    px = F.struct(*[F.col(f"px.{c}").cast("array<int>").alias(c) for c in ("y", "x", *"rgb")])
    return whole.select("image_id", "w", "h", SL.per_row(placed, SL.BYTES)(F.col("w"), F.col("h"), px).alias("vals"))


# --- edges -------------------------------------------------------------------------

def _blurred(p: np.ndarray) -> np.ndarray:
    """1-4-6-4-1 along both axes, edge pixels repeated, in exact 256ths."""
    v = p.astype(np.int64)
    for axis in (1, 0):
        n = v.shape[axis]
        at = lambda d: np.take(v, np.clip(np.arange(n) + d, 0, n - 1), axis)  # noqa: B023, E731
        v = at(-2) + at(2) + 4 * (at(-1) + at(1)) + 6 * v
    return v


def _gradients(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``gx, gy, m2`` of the strongest channel, the first winning ties; 0 on the frame."""
    v = _blurred(p)
    gx, gy = np.zeros_like(v), np.zeros_like(v)
    if min(v.shape[:2]) > 2:
        across, along = v[:, 2:] - v[:, :-2], v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]
        gx[1:-1, 1:-1] = across[:-2] + 2 * across[1:-1] + across[2:]
        gy[1:-1, 1:-1] = along[2:] - along[:-2]
    m2 = gx * gx + gy * gy
    best = np.argmax(m2, -1)[..., None]
    return tuple(np.take_along_axis(a, best, -1)[..., 0] for a in (gx, gy, m2))


def _around(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The neighbour of each cell; nothing beyond the frame."""
    h, w = a.shape
    return np.pad(a, 1)[1 + dy:h + 1 + dy, 1 + dx:w + 1 + dx]


def _thin(gx: np.ndarray, gy: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Where the gradient is largest along its own direction."""
    sector = np.rint(np.arctan2(gy, gx) / (math.pi / 4)).astype(int) % 4
    on = m2 > 0
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        on &= (sector != s) | ((m2 >= _around(m2, dy, dx)) & (m2 >= _around(m2, -dy, -dx)))
    return on


def _linked(m: np.ndarray) -> np.ndarray:
    """Strong edge pixels and the weak ones connected to them; ``m`` is 0 off the thin edges."""
    if not (m > 0).any():
        return m > 0
    high = max(E.EDGE_FLOOR, m[m > 0].min())
    weak, on = m >= max(E.EDGE_FLOOR * 0.5, high * 0.4), m >= high
    while True:
        grown = on | (weak & SL._around(on, np.maximum))
        if (grown == on).all():
            return on
        on = grown


def _edges(p: np.ndarray) -> dict:
    gx, gy, m2 = _gradients(p)
    mag = np.where(_thin(gx, gy, m2), np.sqrt(m2.astype(float)) / E.UNIT, 0.0)
    at = np.flatnonzero(_linked(mag))
    theta = np.arctan2(gy.ravel()[at].astype(float), gx.ravel()[at].astype(float))
    theta = np.where(theta < 0, theta + math.pi, theta)
    return {"at": at, "theta": np.where(theta >= math.pi, theta - math.pi, theta), "mag": mag.ravel()[at]}


edges_of = SL.per_page(_edges, EDGES, planes=3)


# --- lines -------------------------------------------------------------------------

LINES = T.ArrayType(SL.record(rank=T.IntegerType(), theta=T.DoubleType(), rho=T.DoubleType(), votes=T.LongType(), strength=T.DoubleType()))


def _places(at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """``x, y`` of places in scanline order."""
    at = np.asarray(at, np.int64)
    return at % w, at // w


def _peaks(edges: dict, w: int, h: int, most: int | None) -> list[dict]:
    """Strongest cells of the accumulator one after the other, each silencing its neighbourhood."""
    x, y = _places(edges["at"], w)
    theta, mag = np.asarray(edges["theta"], float), np.asarray(edges["mag"], float)
    weight = 1 + np.floor(np.minimum(mag, E.MAX_VOTE)).astype(np.int64) // 4
    centre = np.rint(theta * 180 / math.pi).astype(int) % E.THETA_BINS
    turn, reach = np.radians(np.arange(E.THETA_BINS, dtype=float)), w + h
    votes = np.zeros((E.THETA_BINS, 2 * reach + 1), np.int64)
    for d in range(-E.VOTE_SPREAD, E.VOTE_SPREAD + 1):
        t = (centre + d) % E.THETA_BINS
        np.add.at(votes, (t, np.rint(x * np.cos(turn[t]) + y * np.sin(turn[t])).astype(int) + reach), weight)
    t, r = np.nonzero(votes >= max(20, int(0.2 * min(w, h))) * 2)
    v = votes[t, r]
    r, out, open_ = r - reach, [], np.ones(len(t), bool)
    for i in np.lexsort((r, t, -v)):
        if not open_[i]:
            continue
        out.append({"t": int(t[i]), "rho": int(r[i]), "votes": int(v[i])})
        if len(out) == most:
            break
        dt = t - t[i]
        near = (np.abs(dt) <= E.SUPPRESS_THETA) & (np.abs(r - r[i]) <= E.SUPPRESS_RHO)
        open_ &= ~(near | ((np.abs(dt) >= E.THETA_BINS - E.SUPPRESS_THETA) & (np.abs(r + r[i]) <= E.SUPPRESS_RHO)))
    return out


def _refitted(peak: dict, rank: int, edges: dict, w: int) -> dict:
    """A peak as a line: in three narrowing rounds the axis of the edge pixels on it, as long as there are eight."""
    x, y = (a.astype(float) for a in _places(edges["at"], w))
    te, mag = np.asarray(edges["theta"], float), np.asarray(edges["mag"], float)
    line = {"rank": rank, "theta": math.radians(peak["t"]), "rho": float(peak["rho"]), "votes": peak["votes"], "strength": 0.0}
    for tol in (4.0, 2.5, 2.0):
        nx, ny = math.cos(line["theta"]), math.sin(line["theta"])
        gap = np.abs(te - line["theta"])
        gap = np.where(gap >= math.pi, gap - math.pi, gap)
        near = (np.abs(x * nx + y * ny - line["rho"]) <= tol) & (np.minimum(gap, math.pi - gap) <= math.radians(20))
        n = int(near.sum())
        if n < 8:
            break
        a, b = x[near], y[near]
        mx, my = a.sum() / n, b.sum() / n
        turn = 0.5 * math.atan2(2 * ((a * b).sum() / n - mx * my), ((a * a).sum() / n - mx * mx) - ((b * b).sum() / n - my * my))
        lx, ly = -math.sin(turn), math.cos(turn)
        if lx * nx + ly * ny < 0:
            lx, ly = -lx, -ly
        theta, rho = math.atan2(ly, lx), lx * mx + ly * my
        if theta < 0 or theta >= math.pi:
            theta, rho = theta + (math.pi if theta < 0 else -math.pi), -rho
        line |= {"theta": theta, "rho": rho, "votes": n, "strength": float(mag[near].sum() / n)}
    return line


def _distinct(lines: list[dict], w: int, h: int) -> list[dict]:
    """Lines with enough votes; of those that lie on each other the first by rank stays."""
    theta, rho = (np.array([x[k] for x in lines], float) for k in ("theta", "rho"))
    kept: list[int] = []
    for i, line in enumerate(lines):
        if line["votes"] < max(20, int(0.2 * min(w, h))):
            continue
        facing = np.cos(theta[kept] - theta[i])
        apart = np.abs(rho[i] - np.where(facing >= 0, 1, -1) * rho[kept])
        if not ((np.arccos(np.clip(np.abs(facing), 0, 1)) < math.radians(1.5)) & (apart < 3)).any():
            kept.append(i)
    return [lines[i] for i in kept]


def _lines(edges: dict, w: int, h: int, most: int | None) -> list[dict]:
    return _distinct([_refitted(p, k, edges, w) for k, p in enumerate(_peaks(edges, w, h, most))], w, h)


def lines_of(edges: Column, most: int | None = None) -> Column:
    """The straight lines of a picture, strongest first; all, or from the first ``most`` peaks."""
    return SL.per_row(lambda *a: _lines(*a, most), LINES)(edges, F.col("w"), F.col("h"))


# --- where an edge is near ---------------------------------------------------------

def _directions(edges: dict, w: int, h: int, reach: int) -> np.ndarray:
    """Directions of the edge pixels, nan elsewhere and for twice ``reach`` around the picture."""
    seen = np.full((h + 4 * reach, w + 4 * reach), np.nan)
    x, y = _places(edges["at"], w)
    seen[y + 2 * reach, x + 2 * reach] = edges["theta"]
    return seen


def _near(seen: np.ndarray, w: int, h: int, reach: int, y: np.ndarray, x: np.ndarray, angle: np.ndarray | float, most: float) -> np.ndarray:
    """Whether an edge pixel within ``reach`` of each place has about the direction ``angle``; nothing is further out than ``reach``."""
    step = np.arange(-reach, reach + 1)
    y, x = np.clip(y, -reach, h - 1 + reach) + 2 * reach, np.clip(x, -reach, w - 1 + reach) + 2 * reach
    gap = np.abs(seen[y[:, None, None] + step[:, None], x[:, None, None] + step] - (angle[:, None, None] if np.ndim(angle) else angle))
    gap = np.where(gap >= math.pi, gap - math.pi, gap)
    return (np.minimum(gap, math.pi - gap) <= most).any((1, 2))


COVERS = T.ArrayType(SL.record(k=INTS, word=SL.LONGS, first=T.DoubleType(), last=T.DoubleType()))


def _covers(lines: list[dict], edges: dict, w: int, h: int, reach: int, angle: float, cell: float, fine: float) -> list[dict]:
    """Along each line a bit for each cell, set where an edge across it is near, and where the line is inside the frame."""
    r, out, seen = float(w + h), [], _directions(edges, w, h, reach)
    u = np.arange(int(r * (2 / fine)) + 1) * fine - r
    for line in lines:
        c, s = math.cos(line["theta"]), math.sin(line["theta"])
        x, y = np.rint(line["rho"] * c - u * s).astype(int), np.rint(line["rho"] * s + u * c).astype(int)
        inside = (x >= -1) & (y >= -1) & (x <= w) & (y <= h)
        if not inside.any():
            out.append(None)
            continue
        at = u[inside]
        hit = _near(seen, w, h, reach, y[inside], x[inside], line["theta"], angle)
        # a fine position speaks for the quarter pixel on either side of it
        cells = np.concatenate([np.floor((at + by + r) / cell).astype(int) for by in (-fine / 2, fine / 2)])
        set_ = np.unique(cells[np.tile(hit, 2) & (cells >= 0)])
        words = np.zeros(int(cells.max()) // 64 + 1, np.uint64)
        np.bitwise_or.at(words, set_ // 64, np.uint64(1) << (set_ % 64).astype(np.uint64))
        out.append({"k": list(range(len(words))), "word": words.view(np.int64).tolist(), "first": float(at[0]), "last": float(at[-1])})
    return out


def covers_of(lines: Column, edges: Column, reach: int, angle: float, cell: float, fine: float) -> Column:
    """For each line ``words`` (by place), ``first`` and ``last``, as ``support.line_covers`` has them."""
    raw = SL.per_row(lambda *a: _covers(*a, reach, angle, cell, fine), COVERS)(lines, edges, F.col("w"), F.col("h"))
    return F.transform(raw, lambda c: F.when(c.isNotNull(), F.struct(F.map_from_arrays(c["k"], c["word"]).alias("words"), c["first"].alias("first"), c["last"].alias("last"))))


# --- sides of an outline -----------------------------------------------------------

def _means(p: np.ndarray, r: int) -> np.ndarray:
    """Mean colours of the full square around each pixel; nan too near the frame."""
    out = np.full(p.shape, np.nan)
    if min(p.shape[:2]) > 2 * r:
        for c in range(3):
            out[r:-r, r:-r, c] = SL._window_sums(p[..., c], r)[r:-r, r:-r] / float((2 * r + 1) ** 2)
    return out


def _inside_colours(p: np.ndarray, lum: np.ndarray, q: np.ndarray, shares: tuple[float, float], step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The bright end of the inside of an outline and its plain average, on every third pixel of every third row."""
    h, w = lum.shape
    y = np.arange(max(0, int(q[:, 1].min())), min(h - 1, math.ceil(q[:, 1].max())) + 1, step)
    (ax, ay), (bx, by) = q.T[..., None], np.roll(q, -1, axis=0).T[..., None]
    spans = (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by)) & (ay != by)
    x = ax + (bx - ax) * ((y - ay) / np.where(ay != by, by - ay, 1.0))
    first, last = np.ceil(np.where(spans, x, np.inf).min(0, initial=np.inf)), np.floor(np.where(spans, x, -np.inf).max(0, initial=-np.inf))
    first, last = np.clip(first, 0, w).astype(int), np.clip(last, -1, w - 1).astype(int)
    at = first[:, None] + np.arange(0, w, step)
    k = np.flatnonzero(at <= last[:, None])
    place = (y[:, None] * w + at).ravel()[k]
    if not len(place):
        return np.full(3, 255.0), np.full(3, 255.0)
    colours, level = p.reshape(-1, 3)[place].astype(np.int64), lum.ravel()[place]
    n = np.bincount(level, minlength=256)
    till = np.cumsum(n)
    begin, end = (math.floor(len(place) * s) for s in shares)
    bright = ((till > begin) & (till - n < end))[level]
    return colours[bright].sum(0) / bright.sum() if bright.any() else np.full(3, 255.0), colours.sum(0) / len(place)


SIDE = {"reach": 2, "angle": math.radians(25), "radius": 4, "offset": 7.0, "contrast": 10.0, "paper_like": 14.0, "fewest": 5, "shares": (0.70, 0.80)}


class _Probe:
    """One picture made ready for many outlines: mean colours, luminance and the directions of its edges."""

    def __init__(self, p: np.ndarray, edges: dict):
        self.p, (self.h, self.w) = p, p.shape[:2]
        self.directions = _directions(edges, self.w, self.h, SIDE["reach"])
        self.means, self.lum = _means(p, SIDE["radius"]), p.astype(np.int64) @ (299, 587, 114) // 1000

    def colour(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.rint(x).astype(int), np.rint(y).astype(int)
        inside = (x >= 0) & (y >= 0) & (x < self.w) & (y < self.h)
        return np.where(inside[:, None], self.means[np.where(inside, y, 0), np.where(inside, x, 0)], np.nan)

    def along(self, quad: list[float], border: list[bool]) -> dict:
        """The places along the four sides of an outline, and the share of them at which an edge along the side is near (1 on frame edges)."""
        q = np.array(quad).reshape(4, 2)
        d, c, framed = np.roll(q, -1, axis=0) - q, ((q[0] + q[1]) + q[2] + q[3]) / 4, np.array(border)
        length = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])
        toward = np.where(-d[:, 1] * (c[0] - q[:, 0]) + d[:, 0] * (c[1] - q[:, 1]) < 0, -1.0, 1.0)
        unit = np.where(length >= 1, length, np.inf)
        nx, ny = -d[:, 1] / unit * toward, d[:, 0] / unit * toward
        n = np.maximum(8, np.floor(length / 2).astype(int))
        side = np.repeat(np.arange(4), n)
        t = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[side]
        px, py = q[side, 0] + d[side, 0] * t, q[side, 1] + d[side, 1] * t
        x, y = np.rint(px).astype(int), np.rint(py).astype(int)
        seen = ~framed[side] & (length >= 1)[side] & (x >= 0) & (y >= 0) & (x < self.w) & (y < self.h)
        angle = np.arctan2(ny, nx)
        angle = np.where(angle < 0, angle + math.pi, angle)
        angle = np.where(angle >= math.pi, angle - math.pi, angle)
        hit = _near(self.directions, self.w, self.h, SIDE["reach"], y[seen], x[seen], angle[side[seen]], SIDE["angle"])
        samples = np.bincount(side[seen], minlength=4)
        fraction = np.where(samples < SIDE["fewest"], 0.3, np.bincount(side[seen], weights=hit, minlength=4) / np.maximum(1, samples))
        fraction = np.where(framed, 1.0, np.where(length < 1, 0.0, fraction))
        return {"q": q, "framed": framed, "length": length, "side": side, "at": (px, py), "normal": (nx[side], ny[side]), "seen": seen, "samples": samples, "fraction": fraction}

    def support(self, s: dict) -> tuple[np.ndarray, float]:
        """How well the sides are backed, and the mean strength of those that are no frame edges."""
        few, side, framed, (px, py), (nx, ny) = SIDE["fewest"], s["side"], s["framed"], s["at"], s["normal"]
        per_side = lambda m, by=None: np.bincount(side[m], weights=None if by is None else by[m], minlength=4)
        gap = lambda a, b: np.abs(a - b).max(-1)
        # real sides: colours inside and outside
        inner, outer = (self.colour(px + nx * by, py + ny * by) for by in (SIDE["offset"], -SIDE["offset"]))
        window = s["seen"] & ~np.isnan(inner[:, 0]) & ~np.isnan(outer[:, 0])
        paper, mean = _inside_colours(self.p, self.lum, s["q"], SIDE["shares"])
        windows, step = per_side(window), gap(inner, outer)
        blind, m = windows < few, np.maximum(1, windows)
        contrast = np.where(blind, 0.7, per_side(window & (step >= SIDE["contrast"])) / m)
        alike = np.where(blind, 0.0, per_side(window & (gap(outer, paper) < SIDE["paper_like"])) / m)
        real = np.where(s["samples"] < few, 0.3, s["fraction"] * np.clip(contrast / 0.6, 0, 1) * (1 - 0.9 * alike))
        strength = np.where((s["samples"] < few) | blind, 0.0, per_side(window, step) / m)
        # frame edges: is the rim nearer to the sheet's colour or to the table's, seen outside the real sides
        like = np.full(4, 0.55)
        if framed.any() and window.any():
            rim, table = self.colour(px + nx * (SIDE["radius"] + 2.0), py + ny * (SIDE["radius"] + 2.0)), outer[window].sum(0) / window.sum()
            known = framed[side] & ~np.isnan(rim[:, 0])
            rims = per_side(known)
            like = np.where((rims < few) | (s["length"] < 1), 0.55, 0.3 + 0.7 * per_side(known & (gap(mean, rim) < gap(table, rim))) / np.maximum(1, rims))
        real = np.where(s["length"] < 1, 0.0, real)
        return np.where(framed, like, real), float(strength[~framed].mean()) if not framed.all() else 0.0


def _score(support: np.ndarray, shape: float) -> float:
    return float(((support[0] + support[1] + support[2] + support[3]) / 4) ** 1.5 * (0.5 + 0.5 * support.min()) * shape)


SCORES = T.ArrayType(SL.record(cand_id=T.LongType(), score=T.DoubleType(), strength=T.DoubleType()))


def _scored(p: np.ndarray, edges: dict, cands: list[dict], best: float, share: float) -> list[dict]:
    """Scores above 0 that reach ``share`` of the best; in the order of their bounds, until no bound does."""
    probe, out = _Probe(p, edges), []
    for c in cands:
        if c["bound"] < share * best:
            break
        sides = probe.along(c["quad"], c["border"])
        # a side is backed by no more than its edges
        if sides["fraction"].min() < 0.15 or _score(sides["fraction"], c["shape"]) * (1 + 1e-9) < share * best:
            continue
        support, strength = probe.support(sides)
        score = 0.0 if support.min() < 0.15 else _score(support, c["shape"])
        if score > 0 and score >= share * best:
            out.append({"cand_id": c["cand_id"], "score": score, "strength": strength})
            best = max(best, score)
    return [c for c in out if c["score"] >= share * best]


scored_of = SL.per_page(_scored, SCORES, planes=3)
