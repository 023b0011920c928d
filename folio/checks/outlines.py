"""Edges, lines and outlines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from folio.checks.base import query, view
from folio.functions import geometry as G
from folio.operators import edges as E
from folio.operators import outline as OL
from folio.operators import raster as R
from folio.operators import scanlines as SL
from folio.operators import sides as SD
from folio.operators import support as SU
from folio.session import checkpointed
from folio.sources import tables as T

Q = F.col

view("epx", "SELECT image_id, w, h, y, x, v AS r, (v * 3) % 256 AS g, 255 - v AS b FROM f2_mosaic", ("f2_mosaic",))


def epx(spark, sf):
    px = T.mosaic_pixels(spark, sf)
    return px.select("image_id", "w", "h", "y", "x", Q("v").alias("r"), (Q("v") * 3 % 256).alias("g"), (255 - Q("v")).alias("b"))


def epx_pages(spark, sf):
    """The pictures of :func:`epx`, one row each."""
    planes = SL.per_page(lambda p: np.stack([p, p * 3, 255 - p], -1), SL.BYTES)  # bytes wrap at 256
    return T.mosaic_pages(spark, sf).withColumn("vals", SL.of(planes))


def clamped(src: str, axis: str, cols: str) -> str:
    """Weighted 1-4-6-4-1 sum over clamped neighbours, by joining."""
    other = "y" if axis == "x" else "x"
    size = "w" if axis == "x" else "h"
    sums = ", ".join(f"CAST(sum(n.{c} * k.wt) AS BIGINT) AS {c}" for c in cols)
    return f"""SELECT p.image_id, p.w, p.h, p.y, p.x, {sums} FROM {src} p CROSS JOIN (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) k(d, wt)
      JOIN (SELECT image_id * 10000000000 + y * 100000 + x AS key, {', '.join(cols)} FROM {src}) n ON n.key = p.image_id * 10000000000
        + {'p.y' if axis == 'x' else 'least(greatest(p.y + k.d, 0), p.h - 1)'} * 100000 + {'least(greatest(p.x + k.d, 0), p.w - 1)' if axis == 'x' else 'p.x'}
      GROUP BY p.image_id, p.w, p.h, p.y, p.x"""


view("eb1", clamped("epx", "x", "rgb"), ("epx",))
view("eb", clamped("eb1", "y", "rgb"), ("eb1",))


@query("win_06_binomial_blur", "eb", """
    SELECT image_id, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(r * ((y * 131 + x * 17) % 1009)) AS BIGINT) AS placed FROM eb GROUP BY image_id""")
def _(spark, sf):
    d = R.binomial_blur(epx(spark, sf), "r", "g", "b")
    return d.groupBy("image_id").agg(*[F.sum(Q(c).cast("bigint")).alias(c) for c in "rgb"], F.sum(Q("r").cast("bigint") * ((Q("y") * 131 + Q("x") * 17) % 1009)).alias("placed"))


def conv(c: str) -> str:
    def at(dy, dx):
        return f"max(CASE WHEN k.dy = {dy} AND k.dx = {dx} THEN n.{c} END)"
    gx = f"({at(-1,1)} + 2 * {at(0,1)} + {at(1,1)}) - ({at(-1,-1)} + 2 * {at(0,-1)} + {at(1,-1)})"
    gy = f"({at(1,-1)} + 2 * {at(1,0)} + {at(1,1)}) - ({at(-1,-1)} + 2 * {at(-1,0)} + {at(-1,1)})"
    return f"{gx} AS {c}x, {gy} AS {c}y"


NINE = "(SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) b(dx)) k"
view("egrad", f"""
    SELECT image_id, w, h, y, x, CASE WHEN rm >= gm AND rm >= bm THEN rx WHEN gm >= bm THEN gx ELSE bx END AS gx,
           CASE WHEN rm >= gm AND rm >= bm THEN ry WHEN gm >= bm THEN gy ELSE by_ END AS gy, greatest(rm, gm, bm) AS m2
    FROM (SELECT *, rx * rx + ry * ry AS rm, gx * gx + gy * gy AS gm, bx * bx + by_ * by_ AS bm FROM (
      SELECT p.image_id, p.w, p.h, p.y, p.x, {conv('r')}, {conv('g')}, {conv('b').replace(' AS by', ' AS by_')}
      FROM eb p CROSS JOIN {NINE} JOIN (SELECT image_id * 10000000000 + y * 100000 + x AS key, r, g, b FROM eb) n ON n.key = p.image_id * 10000000000 + (p.y + k.dy) * 100000 + p.x + k.dx
      WHERE p.x > 0 AND p.y > 0 AND p.x < p.w - 1 AND p.y < p.h - 1 GROUP BY p.image_id, p.w, p.h, p.y, p.x))""", ("eb",))


@query("win_07_sobel", "egrad", "SELECT image_id, count(*) FILTER (WHERE m2 > 0) AS n, CAST(sum(gx) AS BIGINT) AS gx, CAST(sum(gy) AS BIGINT) AS gy, CAST(sum(m2 % 1000003) AS BIGINT) AS m FROM egrad GROUP BY image_id")
def _(spark, sf):
    d = E.gradients(epx(spark, sf))
    return d.groupBy("image_id").agg(F.count_if(Q("m2") > 0).alias("n"), F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.sum(Q("m2") % 1000003).alias("m"))


view("ethin", """
    SELECT s.* FROM (SELECT *, ((CAST(round_even(atan2(gy, gx) / (pi() / 4), 0) AS INTEGER) % 4) + 4) % 4 AS sec FROM egrad WHERE m2 > 0) s
    LEFT JOIN (SELECT image_id * 10000000000 + y * 100000 + x AS key, m2 FROM egrad) a ON a.key = s.image_id * 10000000000 + (y + CASE WHEN sec = 0 THEN 0 ELSE 1 END) * 100000 + x + CASE sec WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END
    LEFT JOIN (SELECT image_id * 10000000000 + y * 100000 + x AS key, m2 FROM egrad) b ON b.key = s.image_id * 10000000000 + (y - CASE WHEN sec = 0 THEN 0 ELSE 1 END) * 100000 + x - CASE sec WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END
    WHERE s.m2 >= coalesce(a.m2, 0) AND s.m2 >= coalesce(b.m2, 0)""", ("egrad",))


@query("win_08_non_max_suppression", "ethin", "SELECT image_id, y, x, m2 FROM ethin")
def _(spark, sf):
    return E.thin(E.gradients(epx(spark, sf))).select("image_id", "y", "x", "m2")


@query("win_09_window_means", "epx", """
    SELECT image_id, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM (SELECT image_id, w, h, y, x, sum(r) OVER c / 81.0 AS r, sum(g) OVER c / 81.0 AS g, sum(b) OVER c / 81.0 AS b FROM (
      SELECT image_id, w, h, y, x, sum(r) OVER q AS r, sum(g) OVER q AS g, sum(b) OVER q AS b FROM epx WINDOW q AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
      WINDOW c AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE x >= 4 AND y >= 4 AND x < w - 4 AND y < h - 4""")
def _(spark, sf):
    return E.window_means(epx(spark, sf)).select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


view("eall", """
    SELECT *, greatest(6, min(mag) OVER (PARTITION BY image_id)) AS high, image_id * 10000000000 + y * 100000 + x AS key FROM (
      SELECT *, sqrt(CAST(m2 AS DOUBLE)) / 1024 AS mag, CASE WHEN a >= pi() THEN a - pi() ELSE a END AS theta FROM (
        SELECT *, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END AS a FROM ethin))""", ("ethin",))
# weak pixels that hang on strong ones, however far: a flood over neighbours
view("eflood", f"""
    SELECT key FROM eall WHERE mag >= high
    UNION SELECT n.key FROM (SELECT key + dy * 100000 + dx AS near FROM eflood CROSS JOIN {NINE}) f JOIN eall n ON n.key = f.near WHERE n.mag >= greatest(3, 0.4::DOUBLE * n.high)""", ("eall",))
view("elinked", "SELECT * FROM eall WHERE key IN (SELECT key FROM eflood)", ("eflood",))
view("evotes", """
    SELECT image_id, t, CAST(round_even(x * cos(radians(t)) + y * sin(radians(t)), 0) AS INTEGER) AS rho, CAST(sum(wt) AS BIGINT) AS votes, count(*) AS n FROM (
      SELECT image_id, x, y, (CAST(round_even(theta * 180 / pi(), 0) AS INTEGER) % 180 + d + 180) % 180 AS t, 1 + CAST(floor(least(mag, 48)) AS INTEGER) // 4 AS wt
      FROM elinked CROSS JOIN (SELECT unnest(range(-3, 4)) AS d)) GROUP BY 1, 2, 3""", ("elinked",))


def linked(spark, sf):
    """All edge pixels, weak ones that hang on strong ones too."""
    return E.linked_edges(E.thin(E.gradients(epx(spark, sf))))


@query("join_16_edge_by_theta", "evotes", "SELECT image_id, CAST(t AS INTEGER) AS t, CAST(sum(n) AS BIGINT) AS pixels, CAST(sum(votes) AS BIGINT) AS weight FROM evotes GROUP BY image_id, t")
def _(spark, sf):
    return E.by_theta(linked(spark, sf)).groupBy("image_id", "t").agg(F.count(F.lit(1)).alias("pixels"), F.sum("weight").alias("weight"))


@query("agg_13_hough_votes", "evotes", "SELECT image_id, CAST(t AS INTEGER) AS t, rho, votes FROM evotes")
def _(spark, sf):
    return E.hough_votes(linked(spark, sf)).select("image_id", "t", "rho", "votes")


@query("join_16_linked_edge_by_theta", "evotes", "SELECT image_id, CAST(t AS INTEGER) AS t, CAST(sum(n) AS BIGINT) AS pixels, CAST(sum(votes) AS BIGINT) AS weight FROM evotes GROUP BY image_id, t")
def _(spark, sf):
    """The same votes, kept under its own name."""
    return E.by_theta(linked(spark, sf)).groupBy("image_id", "t").agg(F.count(F.lit(1)).alias("pixels"), F.sum("weight").alias("weight"))


@query("agg_13_linked_hough_votes", "evotes", "SELECT image_id, CAST(t AS INTEGER) AS t, rho, votes FROM evotes")
def _(spark, sf):
    """The same votes, kept under its own name."""
    return E.hough_votes(linked(spark, sf)).select("image_id", "t", "rho", "votes")


@query("img_07_edge_map", "elinked", "SELECT image_id, y, x, round(theta, 6) AS theta, round(mag, 6) AS mag FROM elinked")
def _(spark, sf):
    """Edge pixels after linking."""
    d = linked(spark, sf)
    return d.select("image_id", "y", "x", F.round("theta", 6).alias("theta"), F.round("mag", 6).alias("mag"))


@query("top_03_hough_peaks")
def _(spark, sf):
    return E.hough_peaks(E.hough_votes(linked(spark, sf))).select("image_id", "rank", "t", "rho", "votes")


@query("agg_14_line_refit")
def _(spark, sf):
    e = checkpointed(linked(spark, sf))  # read once per refit round
    d = E.refit_lines(E.hough_peaks(E.hough_votes(e)), e)
    return d.select("image_id", "rank", F.round("theta", 6).alias("theta"), F.round("rho", 4).alias("rho"), "votes", F.round("strength", 4).alias("strength"))


@query("top_04_distinct_lines")
def _(spark, sf):
    d = E.find_lines(epx(spark, sf))
    return d.select("image_id", "rank", F.round("theta", 6).alias("theta"), F.round("rho", 4).alias("rho"), "votes")


# --- outlines from lines -----------------------------------------------------------

view("ol_line", """
    SELECT image_id, line_id, theta * pi() / 180 AS theta, rho, votes, is_border, strength, CAST(480 AS INTEGER) AS w, CAST(360 AS INTEGER) AS h FROM f7_line
    UNION ALL SELECT image_id, id, t, r, 0, true, 30, 480, 360 FROM (SELECT DISTINCT image_id FROM f7_line) CROSS JOIN (VALUES ('~top', pi() / 2, 0.0::DOUBLE), ('~bottom', pi() / 2, 359.0::DOUBLE), ('~left', 0.0::DOUBLE, 0.0::DOUBLE), ('~right', 0.0::DOUBLE, 479.0::DOUBLE)) b(id, t, r)""", ("f7_line",))


def ad(a: str, b: str) -> str:
    return f"least(CASE WHEN abs({a} - {b}) >= pi() THEN abs({a} - {b}) - pi() ELSE abs({a} - {b}) END, pi() - CASE WHEN abs({a} - {b}) >= pi() THEN abs({a} - {b}) - pi() ELSE abs({a} - {b}) END)"


# pairs come from each picture's own list of lines, so there is no join to plan
view("ol_two", """
    SELECT image_id, ls[i] AS a, ls[j] AS b FROM (SELECT image_id, ls, i, unnest(range(i + 1, len(ls) + 1)) AS j
      FROM (SELECT image_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT image_id, list(l ORDER BY line_id) AS ls FROM ol_line l GROUP BY image_id)))""", ("ol_line",))
view("ol_pair", f"""
    SELECT image_id, a.line_id AS a_id, b.line_id AS b_id, a.theta AS ath, b.theta AS bth, a.rho AS ar, b.rho AS br, a.votes AS av, b.votes AS bv, a.strength AS ast, b.strength AS bst, a.is_border AS ab, b.is_border AS bb
    FROM ol_two WHERE NOT (a.is_border AND b.is_border)
      AND {ad('a.theta', 'b.theta')} <= radians(50.0::DOUBLE) AND abs((cos(a.theta) * 239.5 + sin(a.theta) * 179.5 - a.rho)
      - (CASE WHEN cos(a.theta) * cos(b.theta) + sin(a.theta) * sin(b.theta) >= 0 THEN 1 ELSE -1 END) * (cos(b.theta) * 239.5 + sin(b.theta) * 179.5 - b.rho)) >= 0.15 * 360""", ("ol_two",))


def ol_lines(spark, sf):
    li = T.lines(spark, sf).withColumns({"theta": Q("theta") * math.pi / 180, "w": F.lit(480), "h": F.lit(360)})
    images = li.select("image_id", "w", "h").distinct()
    return li.unionByName(OL.border_lines(images).withColumns({"votes": Q("votes").cast("double")}))


@query("join_04_line_pairs", "ol_pair", "SELECT image_id, a_id, b_id FROM ol_pair")
def _(spark, sf):
    return OL.line_pairs(ol_lines(spark, sf)).select("image_id", Q("a.line_id").alias("a_id"), Q("b.line_id").alias("b_id"))


def corner_sql(a: str, ar: str, b: str, br: str, axis: str) -> str:
    det = f"(cos({a}) * sin({b}) - sin({a}) * cos({b}))"
    num = f"({ar} * sin({b}) - sin({a}) * {br})" if axis == "x" else f"(cos({a}) * {br} - {ar} * cos({b}))"
    return f"CASE WHEN abs({det}) >= 0.3 THEN {num} / {det} END"


_P = (("ath", "ar", "qath", "qar"), ("ath", "ar", "qbth", "qbr"), ("bth", "br", "qbth", "qbr"), ("bth", "br", "qath", "qar"))
_D = lambda i, j: f"sqrt((x{i}-x{j})*(x{i}-x{j})+(y{i}-y{j})*(y{i}-y{j}))"
_C = [f"((x{(i+1)%4}-x{i})*(y{(i+2)%4}-y{(i+1)%4})-(y{(i+1)%4}-y{i})*(x{(i+2)%4}-x{(i+1)%4}))" for i in range(4)]
_A = [f"abs(acos(least(greatest(((x{(i+3)%4}-x{i})*(x{(i+1)%4}-x{i})+(y{(i+3)%4}-y{i})*(y{(i+1)%4}-y{i}))/({_D((i+3)%4, i)}*{_D((i+1)%4, i)}+1e-12),-1),1))-pi()/2)" for i in range(4)]
view("ol_cand", f"""
    SELECT * FROM (SELECT p.*, q.a_id AS qa_id, q.b_id AS qb_id, {', '.join(f"{corner_sql(*c, 'x')} AS x{i}, {corner_sql(*c, 'y')} AS y{i}" for i, c in enumerate(_P))}
      FROM ol_pair p JOIN (SELECT image_id, a_id, b_id, ath AS qath, bth AS qbth, ar AS qar, br AS qbr, ab AS qab, bb AS qbb FROM ol_pair) q ON p.image_id = q.image_id AND (p.a_id < q.a_id OR (p.a_id = q.a_id AND p.b_id < q.b_id))
      WHERE p.a_id <> q.a_id AND p.a_id <> q.b_id AND p.b_id <> q.a_id AND p.b_id <> q.b_id AND {ad('ath', 'qath')} >= radians(30.0::DOUBLE) AND {ad('ath', 'qbth')} >= radians(30.0::DOUBLE)
        AND {ad('bth', 'qath')} >= radians(30.0::DOUBLE) AND {ad('bth', 'qbth')} >= radians(30.0::DOUBLE) AND CAST(ab AS INTEGER) + CAST(bb AS INTEGER) + CAST(qab AS INTEGER) + CAST(qbb AS INTEGER) <= 2)
    WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND (({' AND '.join(c + ' >= 1e-12' for c in _C)}) OR ({' AND '.join(c + ' <= -1e-12' for c in _C)}))
      AND abs((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2 >= 0.04 * 480 * 360 AND {' AND '.join(f"x{i} >= -19.2 AND y{i} >= -19.2 AND x{i} <= 498.2 AND y{i} <= 378.2" for i in range(4))}
      AND least({_D(0, 1)}, {_D(1, 2)}, {_D(2, 3)}, {_D(3, 0)}) >= 36 AND greatest({', '.join(_A)}) <= radians(45.0::DOUBLE)""", ("ol_pair",))


@query("fil_08_outline_rules", "ol_cand", "SELECT image_id, a_id, b_id, qa_id, qb_id FROM ol_cand")
def _(spark, sf):
    d = OL.outline_candidates(OL.line_pairs(ol_lines(spark, sf)))
    s = Q("sides")
    return d.select("image_id", s[0]["line_id"].alias("a_id"), s[2]["line_id"].alias("b_id"), s[3]["line_id"].alias("qa_id"), s[1]["line_id"].alias("qb_id"))


@query("top_05_best_ranked", "ol_cand", "SELECT image_id, least(count(*), 3) AS kept FROM ol_cand GROUP BY image_id")
def _(spark, sf):
    d = OL.best_ranked(OL.outline_candidates(OL.line_pairs(ol_lines(spark, sf))), 3)
    return d.groupBy("image_id").agg(F.count(F.lit(1)).alias("kept"))


@query("agg_17_quad_score", "f7", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN mn < 0.15 THEN 0 ELSE pow(me, 1.5) * (0.5 + 0.5 * mn) * (0.35 + 0.65 * sqrt(ar * vis / (CAST(w AS DOUBLE) * h))) * (1 - least(greatest((degrees(greatest({', '.join(_A)})) - 15) / 45, 0), 0.6)) * (1 - 0.3 * (1 - ar * vis / greatest(1, ar))) END, 6) AS score
    FROM (SELECT *, abs((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2 AS ar, 1 - t AS vis, d * 5 AS mn, (d * 5 + 1) / 2 AS me FROM f7)""")
def _(spark, sf):
    d = T.quad_cases(spark, sf)
    mn = Q("d") * 5
    score = OL.quad_score(Q("quad"), G.quad_area(Q("quad")) * (1 - Q("t")), Q("w"), Q("h"), (mn + 1) / 2, mn)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


@query("top_06_pick_outline")
def _(spark, sf):
    """Best of the ranked candidates per picture, with the rival rule."""
    d = OL.outline_candidates(OL.line_pairs(ol_lines(spark, sf)))
    d = d.select("image_id", "quad", "pre", ((Q("sides")[0]["strength"] + Q("sides")[1]["strength"]) / 2).alias("strength"))
    d = OL.best_ranked(d).withColumns({"cand_id": Q("rank"), "score": Q("pre") / 4})
    return OL.pick_outline(d.select("image_id", "cand_id", "quad", "score", "strength"), 480, 360).select("image_id", "cand_id", F.round("score", 6).alias("score"))


view("ol_sample", """
    SELECT l_orderkey AS side_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_linenumber / 8.0::DOUBLE + abs(l_discount) / 100 AS t,
           CAST(l_suppkey % 9 AS DOUBLE) AS e, 14 + l_quantity AS s FROM lineitem""")


def side_samples(spark, sf):
    li = T.read(spark, sf, "lineitem")
    return li.select(Q("l_orderkey").alias("side_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), (Q("l_linenumber") / 8.0 + F.abs("l_discount") / 100).alias("t"), (Q("l_suppkey") % 9).cast("double").alias("e"), (14 + Q("l_quantity")).alias("s"))


@query("join_18_consensus_line", "ol_sample", """
    , scored AS (SELECT p.side_id, p.t1, p.t2, a, b, sum(CASE WHEN abs(k.e - (a + b * k.t)) <= 2.5 THEN sqrt(k.s) * (1 - 0.5 * abs(k.e - (a + b * k.t)) / 2.5) ELSE 0 END) AS sc FROM (
      SELECT *, e1 - b * t1 AS a FROM (SELECT m.side_id, m.k AS i, n.k AS j, m.t AS t1, n.t AS t2, m.e AS e1, (n.e - m.e) / (n.t - m.t) AS b FROM ol_sample m JOIN ol_sample n ON n.side_id = m.side_id AND n.t - m.t >= 0.1)) p
      JOIN ol_sample k ON k.side_id = p.side_id GROUP BY p.side_id, p.i, p.j, p.t1, p.t2, a, b)
    SELECT side_id, round(a, 4) AS a, round(b, 4) AS b, round(sc, 4) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY side_id ORDER BY round(sc, 9) DESC, t1, t2, a DESC, b DESC) AS place FROM scored) WHERE place = 1""")
def _(spark, sf):
    d = OL.consensus_lines(side_samples(spark, sf), 2.5)
    return d.select("side_id", *[F.round(c, 4).alias(c) for c in ("a", "b", "score")])


@query("agg_18_robust_side_fit")
def _(spark, sf):
    d = OL.robust_lines(side_samples(spark, sf))
    return d.select("side_id", F.round("p0", 4).alias("p0"), F.round("p1", 4).alias("p1"))


@query("win_18_border_runs", "f2", """
    , p AS (SELECT image_id * 8 + y AS side_id, x AS s, v AS step, v >= 120 AS passes FROM f2),
    r AS (SELECT *, s - row_number() OVER (PARTITION BY side_id ORDER BY s) AS g FROM p WHERE passes),
    z AS (SELECT side_id, g, max(s) AS last_s FROM r GROUP BY side_id, g)
    SELECT side_id, CAST(s AS INTEGER) AS s, step FROM (SELECT r.*, row_number() OVER (PARTITION BY r.side_id ORDER BY step DESC, s) AS k FROM r JOIN (SELECT side_id, arg_max(g, last_s) AS g FROM z GROUP BY side_id) b ON b.side_id = r.side_id AND b.g = r.g) WHERE k = 1""")
def _(spark, sf):
    p = T.tile_pixels(spark, sf).select((Q("image_id") * 8 + Q("y")).alias("side_id"), Q("x").alias("s"), Q("v").alias("step"), (Q("v") >= 120).alias("passes"))
    return OL.outermost_runs(p)


# --- sides against the picture -----------------------------------------------------

# one outline per mosaic picture; every fourth has its left side on the frame
view("sd_cand", """
    SELECT image_id, 64 AS w, 64 AS h, CAST(CASE WHEN image_id % 4 = 0 THEN 0 ELSE 5 + image_id % 7 END AS DOUBLE) AS x0, 6.0 + image_id % 5 AS y0, 57.0 - image_id % 6 AS x1, 8.0 - image_id % 4 AS y1,
           55.0 + image_id % 3 AS x2, 58.0 - image_id % 5 AS y2, CAST(CASE WHEN image_id % 4 = 0 THEN 0 ELSE 7 - image_id % 3 END AS DOUBLE) AS x3, 55.0 + image_id % 4 AS y3
    FROM (SELECT DISTINCT image_id FROM f2_mosaic)""", ("f2_mosaic",))


def side_cands(spark, sf):
    i = Q("image_id")
    d = lambda c: c.cast("double")
    left = i % 4 == 0
    quad = F.array(d(F.when(left, 0).otherwise(5 + i % 7)), d(6 + i % 5), d(57 - i % 6), d(8 - i % 4), d(55 + i % 3), d(58 - i % 5), d(F.when(left, 0).otherwise(7 - i % 3)), d(55 + i % 4))
    images = T.mosaic_pixels(spark, sf).select("image_id", "w", "h").distinct()
    return images.select("image_id", "w", "h", F.lit(0).cast("bigint").alias("cand_id"), quad.alias("quad"), F.array(F.lit(False), F.lit(False), F.lit(False), left).alias("border"),
                         G.quad_area(quad).alias("visible"))


_SD = " UNION ALL ".join(f"SELECT image_id, {i} AS side, x{i} AS ax, y{i} AS ay, x{(i + 1) % 4} - x{i} AS dx, y{(i + 1) % 4} - y{i} AS dy, (x0+x1+x2+x3)/4 AS cx, (y0+y1+y2+y3)/4 AS cy, {'image_id % 4 = 0' if i == 3 else 'false'} AS is_border FROM sd_cand"
                        for i in range(4))
view("sd_sample", f"""
    SELECT image_id, side, is_border, k, len, ax + dx * (k + 0.5) / n AS px, ay + dy * (k + 0.5) / n AS py, -dy / len * s AS nx, dx / len * s AS ny
    FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, sqrt(dx * dx + dy * dy) AS len, greatest(8, CAST(floor(sqrt(dx * dx + dy * dy) / 2) AS INTEGER)) AS n,
            CASE WHEN -dy * (cx - ax) + dx * (cy - ay) < 0 THEN -1 ELSE 1 END AS s FROM ({_SD})))""", ("sd_cand",))


@query("join_17_side_samples", "epx sd_sample", """
    SELECT s.image_id, s.side, count(*) AS samples, count(i.v) AS inner_seen, count(o.v) AS outer_seen, CAST(sum(i.v) AS BIGINT) AS inner_sum, CAST(sum(o.v) AS BIGINT) AS outer_sum
    FROM sd_sample s
    LEFT JOIN (SELECT p.image_id, p.y, p.x, sum(n.r) AS v FROM epx p JOIN epx n ON n.image_id = p.image_id AND n.y BETWEEN p.y - 4 AND p.y + 4 AND n.x BETWEEN p.x - 4 AND p.x + 4
               WHERE p.x >= 4 AND p.y >= 4 AND p.x < 60 AND p.y < 60 GROUP BY ALL) i
      ON i.image_id = s.image_id AND i.y = CAST(round_even(py + ny * 7, 0) AS INTEGER) AND i.x = CAST(round_even(px + nx * 7, 0) AS INTEGER)
    LEFT JOIN (SELECT p.image_id, p.y, p.x, sum(n.r) AS v FROM epx p JOIN epx n ON n.image_id = p.image_id AND n.y BETWEEN p.y - 4 AND p.y + 4 AND n.x BETWEEN p.x - 4 AND p.x + 4
               WHERE p.x >= 4 AND p.y >= 4 AND p.x < 60 AND p.y < 60 GROUP BY ALL) o
      ON o.image_id = s.image_id AND o.y = CAST(round_even(py - ny * 7, 0) AS INTEGER) AND o.x = CAST(round_even(px - nx * 7, 0) AS INTEGER)
    WHERE NOT is_border GROUP BY s.image_id, s.side""")
def _(spark, sf):
    rgb = epx(spark, sf)
    edges = E.linked_edges(E.thin(E.gradients(rgb)))
    d = SU.probed(SU.side_samples(side_cands(spark, sf)), SU.look_up(edges, rgb)).filter("NOT is_border")
    level = lambda c: F.sum(F.round(Q(f"{c}.r") * 81).cast("bigint"))
    return d.groupBy("image_id", "side").agg(F.count(F.lit(1)).alias("samples"), F.count("inner").alias("inner_seen"), F.count("outer").alias("outer_seen"),
                                             level("inner").alias("inner_sum"), level("outer").alias("outer_sum"))


_ROW = " UNION ALL ".join(f"""SELECT image_id, y, CASE WHEN NOT ((y < y{i} AND y < y{j}) OR (y > y{i} AND y > y{j}) OR y{i} = y{j}) THEN x{i} + (x{j} - x{i}) * (y - y{i}) / CASE WHEN y{i} <> y{j} THEN y{j} - y{i} END END AS x
    FROM sd_row""" for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)))


@query("agg_15_interior_colors", "epx sd_cand", f"""
    , sd_row AS (SELECT *, unnest(range(CAST(floor(least(y0, y1, y2, y3)) AS BIGINT), CAST(least(63, ceil(greatest(y0, y1, y2, y3))) AS BIGINT) + 1, 3)) AS y FROM sd_cand),
    ext AS (SELECT image_id, y, greatest(0, CAST(ceil(min(x)) AS BIGINT)) AS xs, least(63, CAST(floor(max(x)) AS BIGINT)) AS xe FROM ({_ROW}) GROUP BY image_id, y HAVING min(x) IS NOT NULL),
    pt AS (SELECT p.*, (p.r * 299 + p.g * 587 + p.b * 114) // 1000 AS lum FROM ext e JOIN epx p ON p.image_id = e.image_id AND p.y = e.y AND p.x BETWEEN e.xs AND e.xe AND (p.x - e.xs) % 3 = 0),
    hist AS (SELECT image_id, lum, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM pt GROUP BY image_id, lum),
    run AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY lum) AS till, sum(n) OVER (PARTITION BY image_id) AS total FROM hist)
    SELECT image_id, round(sum(CASE WHEN b_ THEN r END) / CAST(sum(CASE WHEN b_ THEN n END) AS DOUBLE), 6) AS paper_r, round(sum(CASE WHEN b_ THEN g END) / CAST(sum(CASE WHEN b_ THEN n END) AS DOUBLE), 6) AS paper_g,
           round(sum(r) / CAST(sum(n) AS DOUBLE), 6) AS mean_r, round(sum(b) / CAST(sum(n) AS DOUBLE), 6) AS mean_b
    FROM (SELECT *, till > floor(total * CAST(0.7 AS DOUBLE)) AND till - n < floor(total * CAST(0.8 AS DOUBLE)) AS b_ FROM run) GROUP BY image_id""")
def _(spark, sf):
    d = SU.interior_colors(side_cands(spark, sf), epx(spark, sf))
    return d.select("image_id", F.round("paper.r", 6).alias("paper_r"), F.round("paper.g", 6).alias("paper_g"), F.round("mean.r", 6).alias("mean_r"), F.round("mean.b", 6).alias("mean_b"))


@query("agg_16_side_support")
def _(spark, sf):
    """Edge fraction, support and strength of each side; checked on drawn sheets in the tests."""
    rgb = epx(spark, sf)
    edges = E.linked_edges(E.thin(E.gradients(rgb)))
    d = SU.side_supports(side_cands(spark, sf), edges, rgb)
    return d.select("image_id", "side", "is_border", *[F.round(c, 6).alias(c) for c in ("edge_fraction", "support", "edge_strength")])


@query("img_08_detect_outline")
def _(spark, sf):
    """The sheet in every mosaic picture as in a photo: all lines, all candidates and the borders of the frame."""
    d = SU.detect_outline(epx_pages(spark, sf))
    return d.select("image_id", F.transform("quad", lambda v: F.round(v, 6)).alias("quad"), F.round("confidence", 6).alias("confidence"), "found")


@query("img_08_live_outline")
def _(spark, sf):
    """The sheet in every mosaic picture with the settings of the live camera."""
    d = SU.detect_outline(epx_pages(spark, sf), frame_borders=False, edge=320, most_lines=40, most_scored=200)
    return d.select("image_id", F.transform("quad", lambda v: F.round(v, 6)).alias("quad"), F.round("confidence", 6).alias("confidence"), "found")


# --- refining an outline -----------------------------------------------------------

# one sheet per supplier: true corners t0..t7 and the rough ones c0..c7
_SHEET = ["72 + k % 9", "58 + n % 7", "568 - b % 11", "62 + k % 5", "562 + n % 6", "424 - b % 8", "78 - k % 7", "418 + b % 6"]
view("sheet", f"""
    SELECT k AS image_id, {', '.join(f"{q} AS t{i}, {q} + 6 * ((k + {i}) % 3 - 1) AS c{i}" for i, q in enumerate(_SHEET))}, {', '.join(f"(n + {i}) % 3 - 1 AS bend{i // 2}" for i in (0, 2, 4, 6))}
    FROM (SELECT s_suppkey AS k, s_nationkey AS n, CAST(floor(abs(s_acctbal)) AS BIGINT) AS b FROM supplier)""")


def corner_gap(a, b):
    return F.greatest(*[G.dist(p, q) for p, q in zip(G.corners(a), G.corners(b))])


@query("img_09_refine_outline", "sheet", f"""
    SELECT image_id, round(greatest({', '.join(f"sqrt((t{i} - c{i}) * (t{i} - c{i}) + (t{i + 1} - c{i + 1}) * (t{i + 1} - c{i + 1}))" for i in (0, 2, 4, 6))}) / 800, 6) AS rough,
           true AS within, true AS better, 4 AS refined, CAST(abs(bend0) + abs(bend1) + abs(bend2) + abs(bend3) AS INTEGER) AS bent_sides, true AS bends_near FROM sheet""")
def _(spark, sf):
    """Sheets of known outline from rough ones: corners within 1 % of the diagonal and better than before, bulges found where they are."""
    pages = T.sheet_pages(spark, sf)
    found = SD.refine_outline(pages.withColumn("quad", Q("coarse"))).select("image_id", Q("quad").alias("found"), Q("bends").alias("fb"), "refined")
    d = found.join(T.sheet_outlines(spark, sf), "image_id")
    diagonal = G.diagonal(Q("w"), Q("h"))
    rough, now = corner_gap(Q("coarse"), Q("quad")) / diagonal, corner_gap(Q("found"), Q("quad")) / diagonal
    bulge = lambda b, i: F.coalesce(b[2 * i] + b[2 * i + 1] / 2, F.lit(0.0))  # noqa: E731  four times the offset in the middle
    bent = sum((F.abs(bulge(Q("fb"), i)) > 0.015).cast("int") for i in range(4))
    near = F.greatest(*[F.abs(bulge(Q("fb"), i) - bulge(Q("bends"), i)) for i in range(4)]) <= 0.02
    return d.select("image_id", F.round(rough, 6).alias("rough"), (now <= 0.01).alias("within"), (now < rough).alias("better"), "refined", bent.alias("bent_sides"), near.alias("bends_near"))
