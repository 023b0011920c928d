"""Refining a found outline: where the paper really ends along each side, and how the sides bend.

A page is one row with its colour raster (``scanlines``) and its outline. One pass reads the
page once: along 64 places of each side the border is looked for across the side; from the
places found a line, or a line with a bulge, is fitted, and all four sides meet in new corners.
Two passes, a wide and a narrow one, are one function of the row: the raster goes to one Python
worker a task, once, and only the outline comes back; no exchange, no row per pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import scanlines as SL

# fixed values
PLACES = 64
MARGIN = 0.04
LEAST_STEP = 14.0
STEP_SPAN, STEP_KEPT = 6, 0.75
PAPER_LIKE = 48.0
FEWEST = 12
CURVE_FEWEST = 24
NEAR_END = 0.12
SHORT_STRETCH = 0.35
LONG_STRETCH = 0.6
PRIOR_POINTS = 6
MOST_BULGE = 0.12
FIT_ROUNDS = 6
TUKEY = 4.685
MAD = 1.4826
PAPER_SHARE = (0.6, 0.25)
SHARE_CHANGE = 0.35
CORNER_MOVE = 0.12
FLAT_SHARE, FLAT_PIXELS = 0.004, 1.5
OUTSIDE = 0.01
WIDE, NARROW, FAR = (0.12, 6.0, 110.0), (0.035, 6.0, 35.0), (0.25, 0.0, 200.0)


# --- reading the page --------------------------------------------------------------

def _read(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear colours at pixel-edge positions, and which positions lie between pixel centres of the page."""
    h, w = p.shape[:2]
    u, v = x - 0.5, y - 0.5
    ok = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
    u, v = np.where(ok, u, 0.0), np.where(ok, v, 0.0)
    x0, y0 = u.astype(int), v.astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (u - x0)[..., None], (v - y0)[..., None]
    top, bottom = p[y0, x0] * (1 - fx) + p[y0, x1] * fx, p[y1, x0] * (1 - fx) + p[y1, x1] * fx
    return top * (1 - fy) + bottom * fy, ok


def _paper(p: np.ndarray, quad: list[float]) -> dict:
    """Mean of the bright quarter (60 to 85 %) of 19 x 19 places in the middle of the outline."""
    q = np.array(quad).reshape(4, 2)
    u, v = np.meshgrid(0.2 + 0.03 * np.arange(1, 20), 0.2 + 0.03 * np.arange(1, 20), indexing="ij")
    at = [((1 - u) * (1 - v))[..., None] * q[0] + (u * (1 - v))[..., None] * q[1] + (u * v)[..., None] * q[2] + ((1 - u) * v)[..., None] * q[3]][0]
    colours, ok = _read(p, at[..., 0], at[..., 1])
    colours = colours[ok]
    if not len(colours):
        return dict.fromkeys("rgb", 255.0)
    colours = colours[np.argsort(colours @ (0.299, 0.587, 0.114), kind="stable")]
    first = int(len(colours) * PAPER_SHARE[0])
    return dict(zip("rgb", colours[first:first + max(1, int(len(colours) * PAPER_SHARE[1]))].mean(0)))


def _outermost(passes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each row the place of the largest step within the last run of passing places; -1 without any."""
    n = passes.shape[1]
    at = np.arange(n)
    last = np.where(passes.any(1), n - 1 - np.argmax(passes[:, ::-1], axis=1), -1)
    before = ~passes & (at <= last[:, None])
    begin = np.where(before.any(1), n - np.argmax(before[:, ::-1], axis=1), 0)
    run = (at >= begin[:, None]) & (at <= last[:, None])
    return np.where(last >= 0, np.argmax(np.where(run, step, -1.0), axis=1), -1)


def _middle(step: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The middle of the stretch around place ``at`` of each row where the step keeps three quarters of its size.

    A step is taken across six pixels, so a sharp border gives the same step at several places and
    noise alone picks the largest. Steps nobody looked at are nan; a stretch that is cut off there,
    or goes on for longer than one border gives, leaves the place as it is.
    """
    n, rows = step.shape[1], np.arange(len(at))
    top = step[rows, at]
    ends, whole = [], np.ones(len(at), bool)
    for way in (-1, 1):
        k = at[:, None] + way * np.arange(STEP_SPAN + 2)
        v = np.where((k >= 0) & (k < n), step[rows[:, None], np.clip(k, 0, n - 1)], np.nan)
        below = v < STEP_KEPT * top[:, None]
        j = np.maximum(np.argmax(below, axis=1), 1)
        before, after = v[rows, j - 1], v[rows, j]
        whole &= below.any(1)
        ends.append(at + way * (j - 1 + (before - STEP_KEPT * top) / np.where(below.any(1), before - after, 1.0)))
    return np.where(whole, (ends[0] + ends[1]) / 2, at)


def _side_points(p: np.ndarray, a: np.ndarray, b: np.ndarray, normal: np.ndarray, reach: float, paper: np.ndarray) -> dict:
    """Border places along one side: ``t`` along it, ``e`` outward of it, ``s`` the step there; ``off`` where the page ends too soon to tell."""
    none = {k: np.zeros(0) for k in ("t", "e", "s", "off")}
    length = float(np.hypot(*(b - a)))
    if length < 20 or reach <= 0:
        return none
    k = int(np.ceil(reach))
    t, across = MARGIN + (1 - 2 * MARGIN) * np.arange(PLACES) / (PLACES - 1), np.arange(-k, k + 1)
    along = (b - a) / length * 1.5 * np.arange(-2, 3)[:, None]
    at = (a + (b - a) * t[:, None])[:, None, None] + normal * across[None, :, None, None] + along
    colours, ok = _read(p, at[..., 0], at[..., 1])
    profile, ok = colours.mean(2), ok.all(2)
    # the part of each profile that is on the page, from the side outwards and inwards
    high = k + np.logical_and.accumulate(ok[:, k:], axis=1).sum(1) - 1
    low = k - np.logical_and.accumulate(ok[:, :k][:, ::-1], axis=1).sum(1)
    first, last = low + 3, high - 7
    off = (last < first) | (high < k + 8) | (low > k - 4)
    place = np.arange(3, 2 * k + 1 - 7)
    gap = lambda x, y: np.abs(x - y).max(-1)
    inner, outer, beyond = profile[:, place - 3], profile[:, place + 3], profile[:, place + 7]
    scanned = (place >= first[:, None]) & (place <= last[:, None]) & ~off[:, None]
    step = np.where(scanned, gap(inner, outer), 0.0)
    strong = step >= np.maximum(LEAST_STEP, 0.5 * step.max(1, initial=0))[:, None]
    text = (gap(outer, paper) < PAPER_LIKE / 2) & (gap(beyond, paper) < PAPER_LIKE / 2)
    best = _outermost(scanned & strong & (gap(inner, paper) <= PAPER_LIKE) & ~text, step)
    hit = best >= 0
    middle = _middle(np.where(scanned, step, np.nan)[hit], best[hit])
    return {"t": t[hit], "e": place[0] + middle - k, "s": step[hit, best[hit]], "off": t[off]}


def _frame(quad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outward unit normals and lengths of the four sides."""
    along = np.roll(quad, -1, axis=0) - quad
    length = np.hypot(*along.T)
    n = np.stack([along[:, 1], -along[:, 0]], 1) / np.maximum(length, 1e-9)[:, None]
    inward = ((quad.mean(0) - quad) * n).sum(1) > 0
    return np.where(inward[:, None], -n, n), length


def _points(p: np.ndarray, quad: list[float], paper: dict, search: dict) -> list[dict]:
    q = np.array(quad).reshape(4, 2)
    normals, length = _frame(q)
    reach = min(max(search["share"] * length.min(), search["least"]), search["most"])
    colour = np.array([paper[c] for c in "rgb"])
    return [_side_points(p, q[i], q[(i + 1) % 4], normals[i], reach if search["sides"][i] else 0, colour) for i in range(4)]


# --- fitting a side ----------------------------------------------------------------

def consensus(t: np.ndarray, e: np.ndarray, s: np.ndarray, tol: float) -> tuple[float, float] | None:
    """The line through two of the points that most points, weighted, lie near."""
    i, j = np.triu_indices(len(t), 1)
    apart = t[j] - t[i] >= 0.1
    i, j = i[apart], j[apart]
    if not len(i):
        return None
    slope = (e[j] - e[i]) / (t[j] - t[i])
    start = e[i] - slope * t[i]
    gap = np.abs(e - (start[:, None] + slope[:, None] * t))
    score = np.where(gap <= tol, np.sqrt(s) * (1 - 0.5 * gap / tol), 0.0).sum(1)
    k = int(np.argmax(score))
    return (float(start[k]), float(slope[k])) if score[k] > 0 else None


def tukey_fit(t: np.ndarray, e: np.ndarray, s: np.ndarray, terms: int) -> np.ndarray | None:
    """``p0 + p1 t (+ t (1 - t) (p2 + p3 t))`` with far points weighted away; None when too few points keep weight."""
    basis = np.stack([np.ones_like(t), t, t * (1 - t), t * t * (1 - t)][:terms], 1)
    weight, fit = np.sqrt(s), None
    for _ in range(FIT_ROUNDS):
        m = basis.T @ (basis * weight[:, None])
        if abs(np.linalg.det(m)) < 1e-12:
            return fit
        fit = np.linalg.solve(m, basis.T @ (weight * e))
        u = np.abs(e - basis @ fit)
        u = u / (TUKEY * max(1.0, MAD * float(np.median(u))))
        keep = np.where(u < 1, (1 - u * u) ** 2, 0.0)
        if (keep > 0).sum() < max(8, 3 * terms):
            return None
        weight = np.sqrt(s) * keep
    return fit


def _fit(side: dict, length: float, ends: tuple[float, float]) -> tuple[float, float, float, float] | None:
    """Offsets of both ends and the bulge of a side; ``ends`` is where the first outline had its corners."""
    t, e, s, off = (np.array(side[k], float) for k in ("t", "e", "s", "off"))
    tol = max(2.5, 0.006 * length)
    line = consensus(t, e, s, tol) if len(t) >= FEWEST else None
    if line is None:
        return None
    near = np.abs(e - (line[0] + line[1] * t)) <= 3 * tol
    t, e, s = t[near], e[near], s[near]
    if len(t) < FEWEST:
        return None
    low, high = t.min(), t.max()
    if high - low < SHORT_STRETCH:  # moved as a whole: its slope says nothing about the far corner
        shift = float(np.median(e))
        return shift, shift, 0.0, 0.0
    reaches, prior = [low < NEAR_END, high > 1 - NEAR_END], s.max()
    for end, gone, beyond in ((0, low - MARGIN, off < low), (1, 1 - MARGIN - high, off > high)):
        # an end without points because the page stops there: the first outline's corner speaks for it
        if not reaches[end] and low * (1 - end) + (1 - high) * end > NEAR_END and beyond.sum() >= 0.5 * gone * PLACES / (1 - 2 * MARGIN):
            t, e, s = (np.append(x, np.full(PRIOR_POINTS, v)) for x, v in ((t, float(end)), (e, ends[end]), (s, prior)))
            reaches[end] = True
    fit = None
    if len(t) >= CURVE_FEWEST and all(reaches) and high - low > LONG_STRETCH:
        fit = tukey_fit(t, e, s, 4)
        if fit is not None and abs(0.25 * fit[2]) + abs(0.15 * fit[3]) > MOST_BULGE * length:
            fit = None
    if fit is None:
        fit = tukey_fit(t, e, s, 2)
    return None if fit is None else (fit[0], fit[0] + fit[1], *(fit[2:] if len(fit) == 4 else (0.0, 0.0)))


def _fits(points: list[dict], quad: list[float], first: list[float]) -> list[dict | None]:
    q, f = np.array(quad).reshape(4, 2), np.array(first).reshape(4, 2)
    normals, length = _frame(q)
    ends = ((f - q) * normals).sum(1), (np.roll(f - q, -1, axis=0) * normals).sum(1)
    fits = [_fit(points[i], float(length[i]), (ends[0][i], ends[1][i])) for i in range(4)]
    return [None if fit is None else dict(zip("abcd", map(float, fit))) for fit in fits]


# --- from sides to an outline ------------------------------------------------------

def _convex(q: np.ndarray) -> bool:
    a, b = np.roll(q, -1, axis=0) - q, np.roll(q, -2, axis=0) - np.roll(q, -1, axis=0)
    turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    return bool((turn > 1e-12).all() or (turn < -1e-12).all())


def _area(q: np.ndarray) -> float:
    n = np.roll(q, -1, axis=0)
    return abs(float((q[:, 0] * n[:, 1] - q[:, 1] * n[:, 0]).sum())) / 2


def _met(start: np.ndarray, end: np.ndarray) -> np.ndarray | None:
    """Corner ``i`` where side ``i - 1`` and side ``i`` meet; None when two of them are parallel."""
    u = end - start
    before = np.roll(u, 1, axis=0)
    den = before[:, 0] * u[:, 1] - before[:, 1] * u[:, 0]
    if (np.abs(den) < 1e-9).any():
        return None
    gap = start - np.roll(start, 1, axis=0)
    return np.roll(start, 1, axis=0) + before * ((gap[:, 0] * u[:, 1] - gap[:, 1] * u[:, 0]) / den)[:, None]


def _bends(quad: np.ndarray, fits: list[dict | None]) -> list[float]:
    """Two numbers a side, relative to its length; sides that hardly bulge are straight."""
    length, t, out = _frame(quad)[1], np.arange(1, 20) / 20, []
    for n, f in zip(length, fits):
        bulge = np.abs(t * (1 - t) * (f["c"] + f["d"] * t)).max() if f else 0.0
        out += [f["c"] / n, f["d"] / n] if f and n >= 1 and bulge >= max(FLAT_PIXELS, FLAT_SHARE * n) else [0.0, 0.0]
    return out


def _settled(now: dict, fits: list[dict | None], w: int, h: int) -> dict:
    """The outline after a pass: new corners where they are plausible; else the search ends with what there was."""
    if not now["open"]:
        return now
    q = np.array(now["quad"]).reshape(4, 2)
    shift = np.array([(f["a"], f["b"]) if f else (0.0, 0.0) for f in fits])
    normals = _frame(q)[0]
    new = _met(q + normals * shift[:, :1], np.roll(q, -1, axis=0) + normals * shift[:, 1:])
    if new is None or not _convex(new) or abs(_area(new) / _area(q) - 1) > SHARE_CHANGE or np.hypot(*(new - q).T).max() > CORNER_MOVE * np.hypot(w, h):
        return now | {"open": False}
    return {"quad": new.ravel().tolist(), "bends": _bends(new, fits), "refined": sum(f is not None for f in fits), "open": True}


def _kept(now: dict, first: list[float], w: int, h: int) -> list[float]:
    """Corners that were inside the picture stay within one percent of it."""
    q, f = np.array(now["quad"]).reshape(4, 2), np.array(first).reshape(4, 2)
    m = OUTSIDE * min(w, h)
    seen = (f >= -1).all(1) & (f <= (w + 1, h + 1)).all(1)
    kept = np.where(seen[:, None], np.clip(q, -m, (w + m, h + m)), q)
    return (kept if now["refined"] and _convex(kept) else q).ravel().tolist()


REFINED = SL.record(quad=SL.DOUBLES, bends=SL.DOUBLES, refined=T.IntegerType())


def _pass(p: np.ndarray, now: dict, first: list[float], paper: dict, near: tuple[float, float, float], far: tuple[float, float, float] | None) -> dict:
    """One search and fit from the outline ``now``."""
    def fits(reach: tuple[float, float, float], sides: list[bool]) -> list[dict | None]:
        return _fits(_points(p, now["quad"], paper, dict(zip(("share", "least", "most"), reach)) | {"sides": sides}), now["quad"], first)

    if not now["open"]:
        return now
    found = fits(near, [True] * 4)
    if far and None in found:  # sides without any border in reach look further
        found = [f or more for f, more in zip(found, fits(far, [f is None for f in found]))]
    return _settled(now, found, p.shape[1], p.shape[0])


def _refined(vals: pa.Scalar, w: pa.Scalar, h: pa.Scalar, quad: pa.Scalar) -> dict:
    """Both passes over one page; without a page the outline stays."""
    first, w, h = quad.as_py(), w.as_py(), h.as_py()
    now = {"quad": first, "bends": None, "refined": 0, "open": True}
    if vals.is_valid:
        p = SL.page(vals, w, h, 3)
        paper = _paper(p, first)
        now = _pass(p, _pass(p, now, first, paper, WIDE, FAR), first, paper, NARROW, None)
    return {"quad": _kept(now, first, w, h), "bends": now["bends"] if any(now["bends"] or ()) else None, "refined": now["refined"]}


def refine_outline(pages: DataFrame, quad: str = "quad") -> DataFrame:
    """``image_id, quad, bends, refined``: the outline at the paper's real border.

    ``pages``: ``image_id, w, h, vals`` (three bytes a pixel) and the outline in pixels (null:
    nothing to refine). ``bends`` has two numbers a side (null when flat), ``refined`` the sides
    with enough evidence. A pass whose result is implausible ends the search.
    """
    d = pages.filter(F.col(quad).isNotNull()).select("image_id", "w", "h", "vals", F.col(quad).alias("_first"))
    return SL.added(d, _refined, REFINED, ["vals", "w", "h", "_first"], keep=["image_id"])
