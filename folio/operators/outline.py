"""Outlines: overlap and error measures, line pairs, candidates and the choice between them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folio.functions import geometry as G
from folio.functions.arith import clamp
from folio.operators.scanlines import DOUBLES
from folio.session import by_image


def _inside(quad: list[float | None] | None, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``quad_contains`` on the grid ``y`` by ``x``, with the same arithmetic; nowhere where a corner is null."""
    if quad is None or any(v is None for v in quad):
        return np.zeros((len(y), len(x)), bool)
    right = left = np.ones((len(y), len(x)), bool)
    for i in range(0, 8, 2):
        (ax, ay), (bx, by) = quad[i:i + 2], (quad[(i + 2) % 8], quad[(i + 3) % 8])
        cross = ((bx - ax) * (y - ay))[:, None] - (by - ay) * (x - ax)
        right, left = right & ~(cross < 0), left & (cross <= 0)
    return right | left


def _overlap(a: list[float] | None, b: list[float] | None, w: int, h: int, step: int) -> dict:
    x, y = np.arange(0.0, w, step), np.arange(0.0, h, step)
    ia, ib = _inside(a, x, y), _inside(b, x, y)
    return {"inter": int(np.count_nonzero(ia & ib)), "uni": int(np.count_nonzero(ia | ib))}


def overlap(wanted: Column, a: Column, b: Column, w: Column, h: Column, step: int = 4) -> Column:
    """``inter, uni``: grid points in both outlines and in either; null where not ``wanted``."""
    def counts(pairs: pa.Array) -> pa.Array:
        return pa.array([None if r is None else _overlap(*r.values(), step) for r in pairs.to_pylist()], pa.struct([("inter", pa.int64()), ("uni", pa.int64())]))

    pair = F.struct(a.alias("a"), b.alias("b"), w.alias("w"), h.alias("h"))
    return F.arrow_udf(counts, returnType="inter long, uni long")(F.when(wanted, pair))


def quad_iou(df: DataFrame, w: int | Column, h: int | Column, step: int = 4, a: str = "quad", b: str = "quad2", key: str = "case_id") -> DataFrame:
    """``key, inter, uni, iou``: overlap of two outlines counted on a coarse grid over the frame.

    A pair is one row: it is dealt out by its key before the grid, which the frame bounds, is
    counted, so small files of many pairs keep all cores busy and no grid point becomes a row.
    """
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (w, h))
    d = by_image(df.select(key, F.col(a).alias("_a"), F.col(b).alias("_b"), w.alias("_w"), h.alias("_h")), key).filter("_w IS NOT NULL AND _h IS NOT NULL")
    d = d.select(key, overlap(F.lit(True), F.col("_a"), F.col("_b"), F.col("_w"), F.col("_h"), step).alias("_n"))
    n = d.groupBy(key).agg(F.sum("_n.inter").alias("inter"), F.sum("_n.uni").alias("uni"))
    return n.select(key, "inter", "uni", F.round(F.when(F.col("uni") == 0, 0.0).otherwise(F.col("inter") / F.col("uni")), 6).alias("iou"))


def corner_error(found: Column, truth: Column, w: Column, h: Column) -> Column:
    """Worst corner error over the diagonal, under the best cyclic relabelling; truth clamped to the frame."""
    t = [(clamp(x, F.lit(0.0), w.cast("double")), clamp(y, F.lit(0.0), h.cast("double"))) for x, y in G.corners(truth)]
    d = G.corners(found)
    worst = [F.greatest(*[G.dist(t[(i + s) % 4], d[i]) for i in range(4)]) for s in range(4)]
    return reduce(F.least, worst) / G.diagonal(w, h)


# --- from lines to outlines --------------------------------------------------------

# fixed values
MAX_OPPOSITE = math.radians(50)
MIN_CROSSING = math.radians(30)
MIN_AREA = 0.04
NEAR_MARGIN = 0.04
NEAR_BEST = 0.8
MUCH_STRONGER = 2.0


def border_lines(images: DataFrame) -> DataFrame:
    """The four frame edges as lines, for sheets that run out of the picture."""
    w, h = F.col("w") - 1.0, F.col("h") - 1.0
    edge = lambda t, r, n: F.struct(F.lit(t).alias("theta"), r.alias("rho"), F.lit(n).alias("line_id"))
    sides = F.array(edge(math.pi / 2, F.lit(0.0), "~top"), edge(math.pi / 2, h, "~bottom"), edge(0.0, F.lit(0.0), "~left"), edge(0.0, w, "~right"))
    return images.select("image_id", "w", "h", F.explode(sides).alias("s")).select(
        "image_id", "w", "h", "s.line_id", "s.theta", "s.rho", F.lit(0.0).alias("votes"), F.lit(True).alias("is_border"), F.lit(30.0).alias("strength"))


def line_pairs(lines: DataFrame) -> DataFrame:
    """Possible opposite sides: near parallel, clearly apart, not both frame edges.

    ``lines``: ``image_id, w, h, line_id, theta (radians), rho, votes, is_border, strength``.
    Lines are dealt out by picture once and each meets the list of its picture's lines, so there is
    no join; the sides carry ``cos`` and ``sin`` of their direction, computed once a line.
    """
    cols = ["line_id", "theta", "rho", "votes", "is_border", "strength", "cos", "sin", *(c for c in ("cover",) if c in lines.columns)]
    one = F.struct(*cols)
    lines = by_image(lines.filter("image_id IS NOT NULL")).withColumns({"cos": F.cos("theta"), "sin": F.sin("theta")})
    lines = lines.select("image_id", "w", "h", one.alias("a"), F.collect_list(one).over(Window.partitionBy("image_id")).alias("_all"))
    cx, cy = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    d = lines.select("image_id", "w", "h", "a", F.explode("_all").alias("b")).filter((F.col("a.line_id") < F.col("b.line_id")) & ~(F.col("a.is_border") & F.col("b.is_border")))
    off = lambda s: F.col(f"{s}.cos") * cx + F.col(f"{s}.sin") * cy - F.col(f"{s}.rho")
    same = F.col("a.cos") * F.col("b.cos") + F.col("a.sin") * F.col("b.sin") >= 0
    apart = F.abs(off("a") - F.when(same, 1.0).otherwise(-1.0) * off("b")) >= 0.15 * F.least("w", "h")
    return d.filter((G.angle_diff(F.col("a.theta"), F.col("b.theta")) <= MAX_OPPOSITE) & apart)


COMBINED = 1 << 16  # combinations of two pairs that are compared at once
SLACK = 1e-9        # what the rules on corners are widened by before they decide as column expressions


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`geometry.angle_diff`."""
    d = np.abs(a - b)
    d = np.where(d >= math.pi, d - math.pi, d)
    return np.minimum(d, math.pi - d)


def _visible(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """:func:`geometry.with_visible_area` of many outlines (``n, 4``), with the same arithmetic."""
    size = np.full(len(x), x.shape[1])
    for axis, limit, below in ((0, np.zeros_like(w), False), (0, w, True), (1, np.zeros_like(h), False), (1, h, True)):
        k, limit = np.arange(x.shape[1]), limit[:, None]
        after = np.where(k + 1 < size[:, None], k + 1, 0)
        bx, by = np.take_along_axis(x, after, 1), np.take_along_axis(y, after, 1)
        a, b = (x, bx) if axis == 0 else (y, by)
        kept_a, kept_b = (a <= limit, b <= limit) if below else (a >= limit, b >= limit)
        there = k < size[:, None]
        cut = there & (kept_a != kept_b)
        t = (limit - a) / np.where(cut, b - a, 1.0)
        # each corner, then the place where its side crosses the edge; what is left moves to the front
        keep = np.stack([there & kept_a, cut], 2).reshape(len(x), -1)
        order = np.argsort(~keep, axis=1, kind="stable")
        size = keep.sum(1)
        x, y = (np.take_along_axis(np.stack([c, c + (d - c) * t], 2).reshape(len(x), -1), order, 1)[:, :size.max(initial=0)] for c, d in ((x, bx), (y, by)))
    area = np.zeros(len(x))
    for k in range(x.shape[1]):
        n, rows = np.where(k + 1 < size, k + 1, 0), np.arange(len(x))
        area = area + np.where(k < size, x[:, k] * y[rows, n] - x[rows, n] * y[:, k], 0.0)
    return np.abs(area) / 2


def _combinations(t: pa.Table, margin: float) -> Iterator[pa.RecordBatch]:
    """Candidates from the pairs of whole pictures, ``_k`` counting those of one: rules on lines decide, rules on corners leave out what is clearly wrong."""
    t = t.combine_chunks().to_batches()[0]
    of = lambda c: t.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    side = {c: {s: pc.struct_field(t.column(s), c) for s in "ab"} for c in ("line_id", "theta", "rho", "cos", "sin", "is_border")}
    ids = pc.fill_null(pa.concat_arrays([side["line_id"][s] for s in "ab"]).dictionary_encode().indices, -1).to_numpy().reshape(2, -1)
    line = {"a": ids[0], "b": ids[1]}
    num = {c: {s: v.cast(pa.float64()).to_numpy(zero_copy_only=False) for s, v in side[c].items()} for c in ("theta", "rho", "cos", "sin", "is_border")}
    w, h = of("w"), of("h")
    begin = np.flatnonzero(t.column("_k").to_numpy() == 1)
    later = np.repeat([*begin[1:], t.num_rows], np.diff([*begin, t.num_rows])) - np.arange(t.num_rows) - 1
    run = np.concatenate([[0], np.cumsum(later)])
    first = 0
    while first < t.num_rows:
        last = max(first + 1, int(np.searchsorted(run, run[first] + COMBINED, "right")) - 1)
        n = later[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(run[first:last] - run[first], n)
        first = last
        for p, q in (("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")):
            ok = (_angle(num["theta"][p][i], num["theta"][q][j]) >= MIN_CROSSING) & (line[p][i] != line[q][j]) & (line[p][i] >= 0) & (line[q][j] >= 0)
            i, j = i[ok], j[ok]
        border = num["is_border"]
        ok = border["a"][i] + border["b"][i] + border["a"][j] + border["b"][j] <= 2
        i, j = i[ok], j[ok]
        x, y = np.empty((len(i), 4)), np.empty((len(i), 4))
        with np.errstate(all="ignore"):
            for k, (p, q) in enumerate((("a", "a"), ("a", "b"), ("b", "b"), ("b", "a"))):
                (ax, ay, r1), (bx, by, r2) = ([num[c][s][at] for c in ("cos", "sin", "rho")] for s, at in ((p, i), (q, j)))
                det = ax * by - ay * bx
                det = np.where(np.abs(det) >= 0.3, det, np.nan)
                x[:, k], y[:, k] = (r1 * by - ay * r2) / det, (ax * r2 - r1 * bx) / det
            m = (np.minimum if margin > NEAR_MARGIN else np.maximum)(w[i], h[i])[:, None] * margin + SLACK
            ok = ((x >= -m) & (y >= -m) & (x <= w[i][:, None] - 1 + m) & (y <= h[i][:, None] - 1 + m)).all(1)
            i, j, x, y = i[ok], j[ok], x[ok], y[ok]
            dx, dy = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
            length = np.hypot(dx, dy)
            turn = dx * np.roll(dy, -1, 1) - dy * np.roll(dx, -1, 1)
            dot = dx * np.roll(dx, -1, 1) + dy * np.roll(dy, -1, 1)
            area = np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2
            ok = ((turn > -1e-6).all(1) | (turn < 1e-6).all(1)) & (area >= MIN_AREA * w[i] * h[i] * (1 - SLACK)) & (length.min(1) >= 0.10 * np.minimum(w[i], h[i]) * (1 - SLACK))
            ok &= (np.abs(dot) <= (math.sqrt(0.5) + SLACK) * length * np.roll(length, -1, 1)).all(1)
        i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        if len(i):
            quad = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * 8), pa.array(np.stack([x, y], 2).ravel()), type=to_arrow_type(DOUBLES))
            columns = [t.column(c).take(pa.array(at)) for c, at in (("image_id", i), ("w", i), ("h", i), ("a", i), ("b", i), ("a", j), ("b", j))]
            yield pa.RecordBatch.from_arrays([*columns, quad, pa.array(_visible(x, y, w[i], h[i]))], names=["image_id", "w", "h", "pa", "pb", "qa", "qb", "quad", "visible"])


def outline_candidates(pairs: DataFrame, margin: float = NEAR_MARGIN) -> DataFrame:
    """``image_id, w, h, quad, sides, visible, pre``: convex outlines from two pairs of opposite sides.

    Pairs of a picture lie together, in the order of their lines; two of them at a time are
    compared in arrays, angles before corners, so hopeless combinations never become rows. A task
    holds the pairs of one picture, not its combinations.
    """
    place = Window.partitionBy("image_id").orderBy("a.line_id", "b.line_id")
    d = pairs.select("image_id", "w", "h", "a", "b", F.row_number().over(place).alias("_k"))
    kind = {f.name: f.dataType for f in d.schema.fields}
    schema = T.StructType([T.StructField(c, kind[k]) for c, k in (("image_id",) * 2, ("w", "w"), ("h", "h"), ("pa", "a"), ("pb", "b"), ("qa", "a"), ("qb", "b"))]
                          + [T.StructField("quad", DOUBLES), T.StructField("visible", T.DoubleType())])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the picture that has not ended
        for b in batches:
            begin = np.flatnonzero(b.column("_k").to_numpy() == 1)
            if len(begin):
                held.append(b.slice(0, begin[-1]))
                yield from _whole(held, margin)
                held = [b.slice(begin[-1])]
            else:
                held.append(b)
        yield from _whole(held, margin)

    d = d.mapInArrow(combined, schema)
    quad = F.col("quad")
    reach = (F.least if margin > NEAR_MARGIN else F.greatest)("w", "h") * margin
    d = d.filter(plausible_outline(quad, F.col("w"), F.col("h"), reach))
    d = d.withColumn("sides", F.array("pa", "qb", "pb", "qa"))
    pre = F.lit(0.0)
    for i, (a, b) in enumerate(G.sides(quad)):
        s = F.col("sides")[i]
        support = F.least(F.lit(1.0), s["votes"] / F.greatest(F.lit(1.0), G.dist(a, b))) * (0.55 + 0.45 * clamp(s["strength"] / 30, 0.2, 1.0))
        pre = pre + F.when(s["is_border"], 0.55).otherwise(support)
    share = F.col("visible") / (F.col("w").cast("double") * F.col("h"))
    return d.withColumn("pre", pre * (0.6 + 0.4 * F.sqrt(share))).select("image_id", "w", "h", "quad", "sides", "visible", "pre")


def _whole(batches: list[pa.RecordBatch], margin: float) -> Iterator[pa.RecordBatch]:
    if rows := [b for b in batches if b.num_rows]:
        yield from _combinations(pa.Table.from_batches(rows), margin)


def plausible_outline(quad: Column, w: Column, h: Column, reach: Column) -> Column:
    """Convex, big enough, inside the frame, no short side, corners near right angles."""
    return (G.quad_is_convex(quad) & (G.quad_area(quad) >= MIN_AREA * w * h) & G.inside_frame(quad, w, h, reach)
            & (G.min_side(quad) >= 0.10 * F.least(w, h)) & (G.max_angle_deviation(quad) <= math.radians(45)))


def best_ranked(cands: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates with their ``rank`` by the cheap score; with ``most`` only the best of each picture."""
    w = Window.partitionBy("image_id").orderBy(F.desc("pre"), "quad")
    d = cands.withColumn("rank", F.row_number().over(w))
    return d if most is None else d.filter(F.col("rank") <= most)


def quad_shape(quad: Column, visible: Column, w: Column, h: Column) -> Column:
    """What size, angles and the share outside the frame leave of a score."""
    area = visible / (w.cast("double") * h)
    outside = 1 - visible / F.greatest(F.lit(1.0), G.quad_area(quad))
    angle = 1 - clamp((F.degrees(G.max_angle_deviation(quad)) - 15) / 45, 0.0, 0.6)
    return (0.35 + 0.65 * F.sqrt(area)) * angle * (1 - 0.3 * outside)


def quad_score(quad: Column, visible: Column, w: Column, h: Column, mean: Column, least: Column) -> Column:
    """Final score from side supports: mean^1.5, weakest side, size, angles, share outside; 0 when a side has no edge."""
    shape = quad_shape(quad, visible, w, h)
    return F.when(least < 0.15, 0.0).otherwise(F.pow(mean, F.lit(1.5)) * (0.5 + 0.5 * least) * shape)


def pick_outline(scored: DataFrame, w: int | Column, h: int | Column) -> DataFrame:
    """One outline per picture: the best score, unless a near-identical rival has far stronger edges.

    ``scored``: ``image_id, cand_id, quad, score, strength`` with positive scores.
    """
    best = F.max(F.struct("score", (-F.col("cand_id")).alias("o"), "cand_id", "quad", "strength")).over(Window.partitionBy("image_id"))
    d = by_image(scored).withColumn("best", best)
    rival = (F.col("score") >= NEAR_BEST * F.col("best.score")) & (F.col("strength") >= MUCH_STRONGER * F.col("best.strength"))
    size = [F.lit(x) if isinstance(x, int) else x for x in (w, h)]
    d = d.withColumn("_n", overlap(rival, F.col("quad"), F.col("best.quad"), *size))
    near = F.round(F.when(F.col("_n.uni") == 0, 0.0).otherwise(F.col("_n.inter") / F.col("_n.uni")), 6) >= 0.8
    d = d.groupBy("image_id").agg(F.first("best").alias("best"), F.max(F.when(near, F.struct("strength", (-F.col("cand_id")).alias("o"), "cand_id", "score"))).alias("r"))
    return d.select("image_id", F.coalesce("r.cand_id", "best.cand_id").alias("cand_id"), F.coalesce("r.score", "best.score").alias("score"))


def consensus_lines(samples: DataFrame, tol: float) -> DataFrame:
    """``side_id, a, b, score``: the line through two samples that most (weighted) samples lie on.

    ``samples``: ``side_id, k (sample id), t, e, s``, at most 64 per side by construction of the
    side scan, so the pairs of a side are bounded; scores combine before they are compared.
    """
    p = samples.select("side_id", F.col("k").alias("k1"), F.col("t").alias("t1"), F.col("e").alias("e1"))
    q = samples.select(F.col("side_id").alias("_s"), F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("e").alias("e2"))
    pairs = p.join(q, (F.col("side_id") == F.col("_s")) & (F.col("t2") - F.col("t1") >= 0.1)).drop("_s")
    dt = F.col("t2") - F.col("t1")
    pairs = pairs.withColumn("b", (F.col("e2") - F.col("e1")) / F.when(dt >= 0.1, dt)).withColumn("a", F.col("e1") - F.col("b") * F.col("t1"))
    k = samples.select(F.col("side_id").alias("_s"), "t", "e", "s")
    gap = F.abs(F.col("e") - (F.col("a") + F.col("b") * F.col("t")))
    near = pairs.join(k, F.col("side_id") == F.col("_s")).withColumn("gap", gap).filter(F.col("gap") <= tol)
    score = near.groupBy("side_id", "k1", "k2", "t1", "t2", "a", "b").agg(F.sum(F.sqrt("s") * (1 - 0.5 * F.col("gap") / tol)).alias("score"))
    best = score.groupBy("side_id").agg(F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("t1")).alias("o1"), (-F.col("t2")).alias("o2"), "a", "b")).alias("m"))
    return best.select("side_id", "m.a", "m.b", F.col("m.r").alias("score"))


def outermost_runs(profile: DataFrame) -> DataFrame:
    """``side_id, s, step``: steepest point of the outermost run of passing positions on a side profile.

    ``profile``: ``side_id, s, step, passes``; runs are islands of consecutive passing positions.
    """
    w = Window.partitionBy("side_id").orderBy("s")
    d = profile.withColumn("_new", F.when(F.col("passes") & ~F.coalesce(F.lag("passes").over(w), F.lit(False)), 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("passes")
    runs = d.groupBy("side_id", "_run").agg(F.max(F.struct("step", (-F.col("s")).alias("o"))).alias("m"))
    last = runs.groupBy("side_id").agg(F.max_by("m", "_run").alias("m"))
    return last.select("side_id", (-F.col("m.o")).alias("s"), F.col("m.step").alias("step"))


def _basis(terms: int) -> list[Column]:
    t = F.col("t")
    return [F.lit(1.0), t] if terms == 2 else [F.lit(1.0), t, t * (1 - t), t * t * (1 - t)]


def _solved(terms: int) -> list[Column]:
    """The normal equations ``_m{i}{j}`` p = ``_b{i}`` by elimination on the diagonal; null where it is singular."""
    m = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(terms)] + [F.col(f"_b{i}")] for i in range(terms)]
    for k in range(terms):
        pivot = F.when(F.abs(m[k][k]) >= 1e-9, m[k][k])
        m[k] = [c / pivot for c in m[k]]
        for i in range(terms):
            if i != k:
                factor = m[i][k]
                m[i] = [a - factor * b for a, b in zip(m[i], m[k])]
    return [row[terms] for row in m]


def robust_lines(samples: DataFrame, rounds: int = 6, terms: int = 2) -> DataFrame:
    """``side_id, p0, p1 (, p2, p3)``: side offsets ``p0 + p1 t + t (1 - t) (p2 + p3 t)`` with far points reweighted away (Tukey).

    Each round is one set of weighted sums per side. A side gives up (nulls) when after a
    round fewer than ``max(8, 3 * terms)`` samples keep weight; where the sums cannot be
    solved, the fit of the round before stays. The median residual ranks the samples of one side.
    """
    side, least = Window.partitionBy("side_id"), max(8, 3 * terms)
    names = [f"p{i}" for i in range(terms)]
    d = samples.withColumn("wt", F.sqrt("s")).withColumns({n: F.lit(None).cast("double") for n in names})
    d = d.withColumns({"_done": F.lit(False), "_lost": F.lit(False)})
    for _ in range(rounds):
        basis, w, e = _basis(terms), F.col("wt"), F.col("e")
        sums = {f"_m{i}{j}": F.sum(w * basis[i] * basis[j]).over(side) for i in range(terms) for j in range(i, terms)}
        sums |= {f"_b{i}": F.sum(w * basis[i] * e).over(side) for i in range(terms)}
        d = d.withColumns(sums | {"_n": F.count(F.lit(1)).over(side)})
        d = d.withColumns({f"_{n}": x for n, x in zip(names, _solved(terms))})
        fits = reduce(lambda a, b: a & b, [F.col(f"_{n}").isNotNull() for n in names])
        d = d.withColumn("_done", F.col("_done") | ~fits)
        d = d.withColumns({n: F.when(F.col("_done"), F.col(n)).otherwise(F.col(f"_{n}")) for n in names})
        fit = reduce(lambda a, b: a + b, [F.col(n) * x for n, x in zip(names, basis)])
        d = d.withColumn("_r", F.abs(e - fit)).withColumn("_k", F.row_number().over(side.orderBy("_r")))
        mid = (F.col("_k") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_k") == F.floor(F.col("_n") / 2) + 1)
        d = d.withColumn("_mad", F.avg(F.when(mid, F.col("_r"))).over(side))
        u = F.col("_r") / (F.greatest(F.lit(1.0), 1.4826 * F.col("_mad")) * 4.685)
        d = d.withColumn("_keeps", ~F.col("_done") & (u < 1))
        d = d.withColumn("wt", F.when(F.col("_done"), F.col("wt")).when(F.col("_keeps"), F.sqrt("s") * (1 - u * u) * (1 - u * u)).otherwise(0.0))
        few = ~F.col("_done") & (F.sum(F.col("_keeps").cast("int")).over(side) < least)
        d = d.withColumn("_lost", F.col("_lost") | few).withColumn("_done", F.col("_done") | F.col("_lost"))
    return d.groupBy("side_id").agg(*[F.first(F.when(~F.col("_lost"), F.col(n))).alias(n) for n in names])
