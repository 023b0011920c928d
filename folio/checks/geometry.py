"""Outlines, orientations, perspective, sizes and resolutions on every geometry case."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.checks.base import query, view
from folio.functions import geometry as G
from folio.functions.signatures import signature_distance
from folio.sources import tables as T

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
K = ", ".join(KEYS)
Q = F.col


def cases(spark, sf):
    return T.quad_cases(spark, sf)


def out(df, places=6, **cols):
    doubles = {}
    d = df.select(*KEYS, *[c.alias(n) for n, c in cols.items()])
    for n, t in d.dtypes:
        if t == "double" and n in cols:
            doubles[n] = F.round(n, places)
    return d.withColumns(doubles) if doubles else d


AREA = "abs((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2"
CROSS = [f"((x{(i+1)%4}-x{i})*(y{(i+2)%4}-y{(i+1)%4})-(y{(i+1)%4}-y{i})*(x{(i+2)%4}-x{(i+1)%4}))" for i in range(4)]


def contains_sql(x: str, y: str, p: str = "x", q: str = "y") -> str:
    c = [f"(({p}{(i+1)%4}-{p}{i})*({y}-{q}{i})-({q}{(i+1)%4}-{q}{i})*({x}-{p}{i}))" for i in range(4)]
    return "((" + " AND ".join(f"{k}>=0" for k in c) + ") OR (" + " AND ".join(f"{k}<=0" for k in c) + "))"


def d_sql(i: int, j: int, p: str = "x", q: str = "y") -> str:
    return f"sqrt(({p}{i}-{p}{j})*({p}{i}-{p}{j})+({q}{i}-{q}{j})*({q}{i}-{q}{j}))"


@query("sca_01_quad_area", "f7", f"SELECT {K}, round({AREA}, 3) AS area FROM f7")
def _(spark, sf):
    return out(cases(spark, sf), 3, area=G.quad_area(Q("quad")))


@query("sca_02_quad_is_convex", "f7", f"""SELECT {K}, ({' AND '.join(c + '>=1e-12' for c in CROSS)}) OR ({' AND '.join(c + '<=-1e-12' for c in CROSS)}) AS convex,
    abs(sign(x0-x1))=9 AS crossed FROM f7""")
def _(spark, sf):
    d = cases(spark, sf)
    swapped = F.array(*[Q("quad")[i] for i in (0, 1, 4, 5, 2, 3, 6, 7)])
    return out(d, convex=G.quad_is_convex(Q("quad")), crossed=G.quad_is_convex(swapped))


@query("sca_03_quad_contains", "f7", f"SELECT {K}, {contains_sql('(w*t*10)', '(h*d*10)')} AS inside, {contains_sql('x0', 'y0')} AS corner FROM f7")
def _(spark, sf):
    q = Q("quad")
    return out(cases(spark, sf), inside=G.quad_contains(q, Q("w") * Q("t") * 10, Q("h") * Q("d") * 10), corner=G.quad_contains(q, q[0], q[1]))


@query("sca_04_quad_scale", "f7", f"""SELECT {K}, round(x0/w,6) AS sx0, round(y0/h,6) AS sy0, round(x2/w,6) AS sx2, round(y2/h,6) AS sy2, round(x3/w,6) AS sx3, round(y3/h,6) AS sy3,
    round(d,6) AS ix0, round(1-d,6) AS ix1, CAST(0 AS DOUBLE) AS fx0, CAST(1 AS DOUBLE) AS fy2 FROM f7""")
def _(spark, sf):
    q = G.quad_scale(Q("quad"), 1 / Q("w"), 1 / Q("h"))
    d = cases(spark, sf)
    # scaled by the reciprocal on one side, divided on the other: equal to the places kept
    i, f = G.quad_inset(Q("d")), G.quad_full()
    return out(d, sx0=q[0], sy0=q[1], sx2=q[4], sy2=q[5], sx3=q[6], sy3=q[7], ix0=i[0], ix1=i[2], fx0=f[0], fy2=f[5])


@query("sca_05_quad_order", "f7", f"""
    SELECT {K}, round(px[s], 6) AS ox0, round(py[s], 6) AS oy0, round(px[s % 4 + 1], 6) AS ox1, round(py[s % 4 + 1], 6) AS oy1,
           round(px[(s + 1) % 4 + 1], 6) AS ox2, round(py[(s + 1) % 4 + 1], 6) AS oy2, round(px[(s + 2) % 4 + 1], 6) AS ox3, round(py[(s + 2) % 4 + 1], 6) AS oy3
    FROM (SELECT {K}, list(x ORDER BY a, x, y) AS px, list(y ORDER BY a, x, y) AS py,
                 list_position(list(x + y ORDER BY a, x, y), min(x + y)) AS s
          FROM (SELECT {K}, rid, x, y, atan2(y - (sum(y) OVER g) / 4, x - (sum(x) OVER g) / 4) AS a
                FROM (SELECT {K}, rid, unnest([x2, x0, x3, x1]) AS x, unnest([y2, y0, y3, y1]) AS y
                      FROM (SELECT *, row_number() OVER () AS rid FROM f7)) WINDOW g AS (PARTITION BY rid))
          GROUP BY {K}, rid)""")
def _(spark, sf):
    q = Q("quad")
    mixed = F.array(*[q[i] for i in (4, 5, 0, 1, 6, 7, 2, 3)])
    o = G.quad_order(mixed)
    return out(cases(spark, sf).withColumn("o", o), ox0=Q("o")[0], oy0=Q("o")[1], ox1=Q("o")[2], oy1=Q("o")[3],
               ox2=Q("o")[4], oy2=Q("o")[5], ox3=Q("o")[6], oy3=Q("o")[7])


@query("sca_06_quad_rotate", "f7", f"""
    SELECT {K}, round(CASE tt WHEN 1 THEN 1-y3/h WHEN 2 THEN 1-x2/w WHEN 3 THEN y1/h ELSE x0/w END, 6) AS rx0,
           round(CASE tt WHEN 1 THEN x3/w WHEN 2 THEN 1-y2/h WHEN 3 THEN 1-x1/w ELSE y0/h END, 6) AS ry0,
           round(CASE tt WHEN 1 THEN 1-y1/h WHEN 2 THEN 1-x0/w WHEN 3 THEN y3/h ELSE x2/w END, 6) AS rx2,
           round(CASE tt WHEN 1 THEN x1/w WHEN 2 THEN 1-y0/h WHEN 3 THEN 1-x3/w ELSE y2/h END, 6) AS ry2
    FROM (SELECT *, ((deg // 90) % 4 + 4) % 4 AS tt FROM f7)""")
def _(spark, sf):
    q = F.array(*[Q("quad")[i] / Q("w" if i % 2 == 0 else "h") for i in range(8)])
    d = cases(spark, sf).withColumn("r", G.rotate_quad(q, (Q("deg") / 90).cast("int")))
    return out(d, rx0=Q("r")[0], ry0=Q("r")[1], rx2=Q("r")[4], ry2=Q("r")[5])


@query("sca_07_upright_to_stored", "f7", f"""
    SELECT {K}, round(CASE e WHEN 2 THEN 1-u WHEN 3 THEN 1-u WHEN 5 THEN v WHEN 6 THEN v WHEN 7 THEN 1-v WHEN 8 THEN 1-v ELSE u END, 6) AS sx,
           round(CASE e WHEN 3 THEN 1-v WHEN 4 THEN 1-v WHEN 5 THEN u WHEN 6 THEN 1-u WHEN 7 THEN 1-u WHEN 8 THEN u ELSE v END, 6) AS sy
    FROM (SELECT *, x2/w AS u, y2/h AS v, CASE WHEN exif BETWEEN 1 AND 8 THEN exif ELSE 1 END AS e FROM f7)""")
def _(spark, sf):
    q = F.array(*[Q("quad")[i] / Q("w" if i % 2 == 0 else "h") for i in range(8)])
    d = cases(spark, sf).withColumn("s", G.upright_to_stored(q, Q("exif")))
    return out(d, sx=Q("s")[4], sy=Q("s")[5])


@query("sca_08_compose_rotation", "f7", f"""
    SELECT {K}, CASE WHEN e IN (1, 6, 3, 8) THEN [1, 6, 3, 8][(list_position([1, 6, 3, 8], e) - 1 + tt) % 4 + 1]
                     ELSE [2, 7, 4, 5][(list_position([2, 7, 4, 5], e) - 1 + tt) % 4 + 1] END AS orientation
    FROM (SELECT *, ((deg // 90) % 4 + 4) % 4 AS tt, CASE WHEN exif BETWEEN 1 AND 8 THEN exif ELSE 1 END AS e FROM f7)""")
def _(spark, sf):
    return out(cases(spark, sf), orientation=G.compose_rotation(Q("exif"), Q("deg")))


@query("sca_09_upright_size", "f7", f"""SELECT {K}, exif IN (5,6,7,8) AS transposed, CASE WHEN exif IN (5,6,7,8) THEN h ELSE w END AS uw,
    CASE WHEN exif IN (5,6,7,8) THEN w ELSE h END AS uh FROM f7""")
def _(spark, sf):
    uw, uh = G.upright_size(Q("w"), Q("h"), Q("exif"))
    return out(cases(spark, sf), transposed=G.is_transposed(Q("exif")), uw=uw, uh=uh)


@query("sca_10_fit_long_edge", "f7", f"""
    SELECT {K}, CASE WHEN greatest(w, h) <= e THEN w ELSE greatest(1, CAST(round_even(w * (e / CAST(greatest(w, h) AS DOUBLE)), 0) AS INTEGER)) END AS fw,
           CASE WHEN greatest(w, h) <= e THEN h ELSE greatest(1, CAST(round_even(h * (e / CAST(greatest(w, h) AS DOUBLE)), 0) AS INTEGER)) END AS fh
    FROM (SELECT *, CAST(q * 100 AS INTEGER) AS e FROM f7)""")
def _(spark, sf):
    fw, fh = G.fit_long_edge(Q("w"), Q("h"), (Q("q") * 100).cast("int"))
    return out(cases(spark, sf), fw=fw, fh=fh)


@query("sca_11_decode_sample_size", "f7", f"""
    SELECT {K}, CAST(greatest(1, max(p)) AS INTEGER) AS sample FROM (SELECT {K}, rid, greatest(w, h) AS m, CAST(q * 40 AS INTEGER) AS e, unnest([1,2,4,8,16,32,64,128,256,512,1024,2048,4096,8192]) AS p
      FROM (SELECT *, row_number() OVER () AS rid FROM f7)) WHERE m // p >= e OR p = 1 GROUP BY {K}, rid""")
def _(spark, sf):
    return out(cases(spark, sf), sample=G.decode_sample_size(Q("w"), Q("h"), (Q("q") * 40).cast("int")))


view("f7_sides", f"""
    SELECT *, {d_sql(0, 1)} AS top, {d_sql(3, 2)} AS bot, {d_sql(0, 3)} AS lef, {d_sql(1, 2)} AS rig FROM f7""", ("f7",))


@query("sca_12_shape", "f7_sides", f"""
    SELECT {K}, round(wa / ha, 6) AS side_ratio, round(greatest(wa, ha) / least(wa, ha), 6) AS shape_ratio,
           greatest(wa, ha) / least(wa, ha) BETWEEN 1.15 AND 1.75 AS a4_like, top + bot > lef + rig AS landscape
    FROM (SELECT *, (top + bot) / 2 AS wa, (lef + rig) / 2 AS ha FROM f7_sides)""")
def _(spark, sf):
    q = Q("quad")
    return out(cases(spark, sf), side_ratio=G.side_ratio(q), shape_ratio=G.shape_ratio(q), a4_like=G.is_a4_like(q), landscape=G.is_landscape(q))


view("f7_n", """
    SELECT *, CASE WHEN k2 IS NOT NULL THEN k2 * mbx - max END AS n2x, CASE WHEN k2 IS NOT NULL THEN k2 * mby - may END AS n2y, k2 - 1 AS n2z,
           k3 * mcx - max AS n3x, k3 * mcy - may AS n3y, k3 - 1 AS n3z, sqrt(CAST(w AS DOUBLE) * w + CAST(h AS DOUBLE) * h) AS diag
    FROM (SELECT *, CASE WHEN abs(den2) >= 1e-9 AND abs(den3) >= 1e-9 THEN num2 / den2 END AS k2,
                    CASE WHEN abs(den2) >= 1e-9 AND abs(den3) >= 1e-9 THEN num3 / den3 END AS k3
          FROM (SELECT *, (mby * 1.0 - 1.0 * mdy) * mcx + (1.0 * mdx - mbx * 1.0) * mcy + (mbx * mdy - mby * mdx) * 1.0 AS den2,
                       (mcy * 1.0 - 1.0 * mdy) * mbx + (1.0 * mdx - mcx * 1.0) * mby + (mcx * mdy - mcy * mdx) * 1.0 AS den3,
                       (may * 1.0 - 1.0 * mdy) * mcx + (1.0 * mdx - max * 1.0) * mcy + (max * mdy - may * mdx) * 1.0 AS num2,
                       (may * 1.0 - 1.0 * mdy) * mbx + (1.0 * mdx - max * 1.0) * mby + (max * mdy - may * mdx) * 1.0 AS num3
                FROM (SELECT *, x0 - w / 2 AS max, y0 - h / 2 AS may, x1 - w / 2 AS mbx, y1 - h / 2 AS mby, x3 - w / 2 AS mcx, y3 - h / 2 AS mcy,
                             x2 - w / 2 AS mdx, y2 - h / 2 AS mdy, (top + bot) / 2 / ((lef + rig) / 2) AS side FROM f7_sides)))""", ("f7_sides",))


def aspect_sql(f: str) -> str:
    return f"""(CASE WHEN k2 IS NOT NULL AND n2x*n2x+n2y*n2y+({f})*({f})*n2z*n2z > 0 AND n3x*n3x+n3y*n3y+({f})*({f})*n3z*n3z > 0
       AND sqrt((n2x*n2x+n2y*n2y+({f})*({f})*n2z*n2z)/(n3x*n3x+n3y*n3y+({f})*({f})*n3z*n3z)) > 0.05
       AND sqrt((n2x*n2x+n2y*n2y+({f})*({f})*n2z*n2z)/(n3x*n3x+n3y*n3y+({f})*({f})*n3z*n3z)) < 20
      THEN sqrt((n2x*n2x+n2y*n2y+({f})*({f})*n2z*n2z)/(n3x*n3x+n3y*n3y+({f})*({f})*n3z*n3z)) ELSE side END)"""


@query("sca_13_vanishing_directions", "f7_n", f"SELECT {K}, round(n2x, 2) AS n2x, round(n2y, 2) AS n2y, round(n2z, 6) AS n2z, round(n3x, 2) AS n3x, round(n3y, 2) AS n3y, round(n3z, 6) AS n3z FROM f7_n")
def _(spark, sf):
    d = G.with_vanishing(cases(spark, sf))
    return d.select(*KEYS, *[F.round(f"{n}.{a}", 6 if a == "z" else 2).alias(f"{n}{a}") for n in ("n2", "n3") for a in "xyz"])


FOCAL = """CASE WHEN abs(n2z) > 1e-6 AND abs(n3z) > 1e-6 AND abs(n2z*n3z) > 1e-12 AND -(n2x*n3x+n2y*n3y)/(n2z*n3z) > 0
    THEN sqrt(-(n2x*n3x+n2y*n3y)/(n2z*n3z)) / diag END"""
view("f7_focal", f"SELECT *, {FOCAL} AS focal FROM f7_n", ("f7_n",))


@query("sca_14_true_aspect", "f7_focal", f"""
    SELECT {K}, round(focal, 6) AS focal, round({aspect_sql('foc')}, 6) AS true_aspect FROM (
      SELECT *, CASE WHEN focal > 0.35 AND focal < 3.0 THEN focal * diag ELSE CAST(0.75 AS DOUBLE) * diag END AS foc FROM f7_focal)""")
def _(spark, sf):
    return out(G.with_true_aspect(cases(spark, sf)), focal=Q("focal"), true_aspect=Q("true_aspect"))


@query("sca_15_aspect_for_focal", "f7_n", f"SELECT {K}, round({aspect_sql('w + q * 20')}, 6) AS aspect FROM f7_n")
def _(spark, sf):
    d = G.with_vanishing(cases(spark, sf))
    return out(d, aspect=G.aspect_for_focal(Q("quad"), Q("w") + Q("q") * 20))


view("f7_aspect", f"""
    SELECT *, CASE WHEN NOT sheet THEN corrected WHEN corrected >= 1 THEN CAST(1.41421356237 AS DOUBLE) ELSE 1 / CAST(1.41421356237 AS DOUBLE) END AS aspect
    FROM (SELECT *, (CASE WHEN side >= 1 THEN side ELSE 1 / side END) BETWEEN 1.15 AND 1.75
                 OR abs((CASE WHEN corrected >= 1 THEN corrected ELSE 1 / corrected END) / CAST(1.41421356237 AS DOUBLE) - 1) <= 0.12 AS sheet
          FROM (SELECT *, least(greatest({aspect_sql('CAST(0.62 AS DOUBLE) * diag')}, side / CAST(1.2 AS DOUBLE)), side * CAST(1.2 AS DOUBLE)) AS corrected FROM f7_n))""", ("f7_n",))


@query("sca_16_output_aspect", "f7_aspect", f"SELECT {K}, round(corrected, 6) AS free, round(aspect, 6) AS aspect FROM f7_aspect")
def _(spark, sf):
    d = G.with_output_aspect(G.with_output_aspect(cases(spark, sf), a4=False, name="free"), a4=True)
    return out(d, free=Q("free"), aspect=Q("aspect"))


def fit_sql(w: str, h: str, edge: str, px: str, k: str) -> str:
    return (f"greatest(16, CAST(round_even({k} * least(CAST(1 AS DOUBLE), least(CAST({edge} AS DOUBLE) / greatest({w}, {h}), "
            f"sqrt(CAST({px} AS DOUBLE) / ({w} * {h})))), 0) AS BIGINT))")


view("f7_size", f"""
    SELECT *, {fit_sql('bw', 'bh', '2147483647', '9223372036854775807', 'bw')} AS fw, {fit_sql('bw', 'bh', '2147483647', '9223372036854775807', 'bh')} AS fh,
           {fit_sql('bw', 'bh', '3508', '8700000', 'bw')} AS cw, {fit_sql('bw', 'bh', '3508', '8700000', 'bh')} AS ch
    FROM (SELECT *, greatest(greatest(lef, rig), greatest(top, bot) / aspect) * aspect AS bw, greatest(greatest(lef, rig), greatest(top, bot) / aspect) AS bh FROM f7_aspect)""", ("f7_aspect",))


@query("sca_17_sizes", "f7_size", f"""
    SELECT {K}, cw, ch, {fit_sql('mw', 'mh', '1800', '3240000', 'mw')} AS ow, {fit_sql('mw', 'mh', '1800', '3240000', 'mh')} AS oh,
           CASE WHEN land THEN al ELSE greatest(16, CAST(round_even(al / CAST(1.41421356237 AS DOUBLE), 0) AS BIGINT)) END AS aw,
           CASE WHEN land THEN greatest(16, CAST(round_even(al / CAST(1.41421356237 AS DOUBLE), 0) AS BIGINT)) ELSE al END AS ah
    FROM (SELECT *, greatest(23, CAST(round_even(least(CASE WHEN land THEN greatest(mw, mh * CAST(1.41421356237 AS DOUBLE)) ELSE greatest(mh, mw * CAST(1.41421356237 AS DOUBLE)) END,
              least(CAST(3508 AS DOUBLE), sqrt(8700000 * CAST(1.41421356237 AS DOUBLE)))), 0) AS BIGINT)) AS al
          FROM (SELECT *, greatest(top, bot) AS mw, greatest(lef, rig) AS mh, top + bot > lef + rig AS land FROM f7_size))""")
def _(spark, sf):
    d = G.with_output_aspect(cases(spark, sf))
    q = Q("quad")
    cw, ch = G.size_for(q, Q("aspect"), G.MAX_LONG_EDGE, G.MAX_PIXELS)
    ow, oh = G.output_size(q, 1800, 1800 * 1800)
    aw, ah = G.a4_size(q, G.MAX_LONG_EDGE, G.MAX_PIXELS)
    return out(d, cw=cw, ch=ch, ow=ow, oh=oh, aw=aw, ah=ah)


PLAN = f"""
    SELECT *, CASE WHEN a4 THEN CASE WHEN cw > ch THEN lo ELSE sh END ELSE greatest(16, CAST(round_even(cw * kk, 0) AS BIGINT)) END AS out_w,
           CASE WHEN a4 THEN CASE WHEN cw > ch THEN sh ELSE lo END ELSE greatest(16, CAST(round_even(ch * kk, 0) AS BIGINT)) END AS out_h
    FROM (SELECT *, greatest(16, CAST(round_even(lo / CAST(1.41421356237 AS DOUBLE), 0) AS BIGINT)) AS sh
          FROM (SELECT *, greatest(23, CAST(round_even(greatest(cw, ch) * kk, 0) AS BIGINT)) AS lo
                FROM (SELECT *, least(CAST(1 AS DOUBLE), (CAST(1 AS DOUBLE) / sample) / wanted) AS kk, abs((CASE WHEN aspect >= 1 THEN aspect ELSE 1 / aspect END) - CAST(1.41421356237 AS DOUBLE)) < 0.005 AS a4
                      FROM (SELECT *, CASE WHEN CAST(rw AS DOUBLE) / s0 * (CAST(rh AS DOUBLE) / s0) <= 16000000 THEN s0 WHEN CAST(rw AS DOUBLE) / (s0 * 2) * (CAST(rh AS DOUBLE) / (s0 * 2)) <= 16000000 THEN s0 * 2 ELSE s0 * 4 END AS sample
                            FROM (SELECT *, greatest(1, rx1 - rx0) AS rw, greatest(1, ry1 - ry0) AS rh,
                                         CASE WHEN CAST(0.125 AS DOUBLE) >= wanted THEN 8 WHEN CAST(0.25 AS DOUBLE) >= wanted THEN 4 WHEN CAST(0.5 AS DOUBLE) >= wanted THEN 2 ELSE 1 END AS s0
                                  FROM (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(cw AS DOUBLE) / fw, CAST(ch AS DOUBLE) / fh)) AS wanted,
                                               greatest(0, CAST(floor(px_lo) AS BIGINT) - 2) AS rx0, greatest(0, CAST(floor(py_lo) AS BIGINT) - 2) AS ry0,
                                               least(w, CAST(ceil(px_hi) AS BIGINT) + 2) AS rx1, least(h, CAST(ceil(py_hi) AS BIGINT) + 2) AS ry1 FROM SOURCE))))))"""
view("f7_plan", PLAN.replace("FROM SOURCE", "FROM (SELECT *, least(x0,x1,x2,x3) AS px_lo, least(y0,y1,y2,y3) AS py_lo, greatest(x0,x1,x2,x3) AS px_hi, greatest(y0,y1,y2,y3) AS py_hi FROM f7_size)"), ("f7_size",))


@query("sca_18_crop_plan", "f7_plan", f"""SELECT {K}, rx0 AS region_x, ry0 AS region_y, rw AS region_w, rh AS region_h, sample, out_w, out_h FROM f7_plan""")
def _(spark, sf):
    d = G.with_crop_plan(cases(spark, sf))
    return d.select(*KEYS, "region_x", "region_y", "region_w", "region_h", "sample", "out_w", "out_h")


def normal_sql(side: int) -> tuple[str, str]:
    i, j = side, (side + 1) % 4
    return f"(x{j}-x{i})", f"(y{j}-y{i})"


def side_point_sql(side: int, t: str) -> tuple[str, str]:
    """Bulging side: chord point plus a normal displacement with the sign that points outward."""
    dx, dy = normal_sql(side)
    i, j = side, (side + 1) % 4
    inward = f"(CASE WHEN (-{dy})*((x0+x1+x2+x3)/4-x{i})+({dx})*((y0+y1+y2+y3)/4-y{i}) > 0 THEN -1 ELSE 1 END)"
    off = f"(({t})*(1-({t}))*(ba+bb*({t})))"
    return (f"(x{i}+{dx}*({t})+{inward}*(-{dy})*{off})", f"(y{i}+{dy}*({t})+{inward}*{dx}*{off})")


_ON = [side_point_sql(s, f"({i} / 16.0::DOUBLE)") for s in range(4) for i in range(17)]
view("f7_bent_plan", PLAN.replace("FROM SOURCE", f"""FROM (SELECT *, least({', '.join(p[0] for p in _ON)}) AS px_lo, least({', '.join(p[1] for p in _ON)}) AS py_lo,
    greatest({', '.join(p[0] for p in _ON)}) AS px_hi, greatest({', '.join(p[1] for p in _ON)}) AS py_hi FROM (SELECT *, d * 2 - 0.1 AS ba, t * 3 AS bb FROM f7_size))"""), ("f7_size",))


@query("sca_18_bent_crop_plan", "f7_bent_plan", f"""SELECT {K}, rx0 AS region_x, ry0 AS region_y, rw AS region_w, rh AS region_h, sample, out_w, out_h FROM f7_bent_plan""")
def _(spark, sf):
    d = cases(spark, sf).withColumn("bends", F.array(*([Q("d") * 2 - 0.1, Q("t") * 3] * 4)))
    d = G.with_crop_plan(d, bends="bends")
    return d.select(*KEYS, "region_x", "region_y", "region_w", "region_h", "sample", "out_w", "out_h")


@query("sca_19_bends", "f7", f"""
    SELECT {K}, round(t * (1 - t) * (ba + bb * t), 6) AS off, {', '.join(f"round({side_point_sql(s, 'q/51')[0]}, 3) AS px{s}, round({side_point_sql(s, 'q/51')[1]}, 3) AS py{s}" for s in range(4))},
           round(bb, 6) AS turned FROM (SELECT *, d * 2 - 0.1 AS ba, t * 3 AS bb FROM f7)""")
def _(spark, sf):
    d = cases(spark, sf).withColumn("ba", Q("d") * 2 - 0.1).withColumn("bb", Q("t") * 3)
    d = d.withColumn("bends", F.array(*([Q("ba"), Q("bb")] * 4)))
    d = d.withColumn("turned", G.bend_rotate_cw(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), Q("ba"), Q("bb")))[1])
    pts = {}
    for s in range(4):
        x, y = G.point_on_side(Q("quad"), Q("bends"), s, Q("q") / 51)
        pts[f"px{s}"], pts[f"py{s}"] = F.round(x, 3), F.round(y, 3)
    return out(d, 6, off=G.bend_offset(Q("ba"), Q("bb"), Q("t")), turned=Q("turned"), **pts)


DIAG_X = "(x0 + (x2-x0) * ((x1-x0)*(y3-y1)-(y1-y0)*(x3-x1)) / ((x2-x0)*(y3-y1)-(y2-y0)*(x3-x1)))"
DIAG_Y = "(y0 + (y2-y0) * ((x1-x0)*(y3-y1)-(y1-y0)*(x3-x1)) / ((x2-x0)*(y3-y1)-(y2-y0)*(x3-x1)))"


@query("sca_20_homography", "f7", f"""
    SELECT {K}, {', '.join(f"round(x{i}, 5) AS hx{i}, round(y{i}, 5) AS hy{i}" for i in range(4))}, CAST(floor(({DIAG_X} + 0.0123457) * 1000) AS BIGINT) AS mx, CAST(floor(({DIAG_Y} + 0.0123457) * 1000) AS BIGINT) AS my FROM f7""")
def _(spark, sf):
    """Corners of the rectangle land on the outline, its middle where the diagonals cross."""
    d = cases(spark, sf).withColumn("m", G.homography(Q("quad"), Q("w"), Q("h")))
    z = F.lit(0.0)
    cols = {}
    for i, (x, y) in enumerate(((z, z), (Q("w"), z), (Q("w"), Q("h")), (z, Q("h")))):
        cols[f"hx{i}"], cols[f"hy{i}"] = G.homography_apply(Q("m"), x, y)
    cols["mx"], cols["my"] = (F.floor((c + 0.0123457) * 1000) for c in G.homography_apply(Q("m"), Q("w") / 2, Q("h") / 2))
    return out(d, 5, **cols)


@query("sca_21_homography_inverse", "f7", f"SELECT {K}, round(w / 2, 3) AS rx, round(h / 2, 3) AS ry, round(w * 0.25, 3) AS cx, round(h * CAST(0.8 AS DOUBLE), 3) AS cy FROM f7")
def _(spark, sf):
    """There and back again: the inverse undoes the map at the middle and off it."""
    d = cases(spark, sf).withColumn("m", G.homography(Q("quad"), Q("w"), Q("h"))).withColumn("i", G.homography_inverse(Q("m")))
    ax, ay = G.homography_apply(Q("m"), Q("w") / 2, Q("h") / 2)
    cx, cy = G.homography_apply(Q("m"), Q("w") * 0.25, Q("h") * 0.8)
    d = d.withColumns({"ax": ax, "ay": ay, "cx": cx, "cy": cy})
    bx, by = G.homography_apply(Q("i"), Q("ax"), Q("ay"))
    ex, ey = G.homography_apply(Q("i"), Q("cx"), Q("cy"))
    return out(d, 3, rx=bx, ry=by, cx=ex, cy=ey)


@query("sca_22_page_dpi", "f7", f"SELECT {K}, greatest(50, CAST(round_even(greatest(w, h) / CAST(11.69 AS DOUBLE), 0) AS INTEGER)) AS dpi FROM f7")
def _(spark, sf):
    return out(cases(spark, sf), dpi=G.page_dpi(Q("w"), Q("h")))


PAPER = "(VALUES (0, 8.27::DOUBLE, 11.69::DOUBLE), (1, 11.69::DOUBLE, 8.27::DOUBLE), (2, 8.5::DOUBLE, 11.0::DOUBLE), (3, 11.0::DOUBLE, 8.5::DOUBLE), (4, 8.5::DOUBLE, 14.0::DOUBLE), (5, 14.0::DOUBLE, 8.5::DOUBLE)) p(o, wi, hi)"
view("f7_px", """
    SELECT *, CAST(l_partkey % 3000 AS INTEGER) AS pw, CAST(l_suppkey % 97 * 40 AS INTEGER) AS ph,
           CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 96.0 WHEN 2 THEN q * 12 ELSE 72.4 END AS tag FROM f7""", ("f7",))
view("f7_est", f"""
    SELECT s.*, CASE WHEN pw <= 0 OR ph <= 0 THEN 200 WHEN e > 0 THEN e ELSE 200 END AS est FROM f7_px s LEFT JOIN (
      SELECT pw AS ew, ph AS eh, CAST(round_even(pw / wi, 0) AS INTEGER) AS e FROM (
        SELECT pw, ph, wi, row_number() OVER (PARTITION BY pw, ph ORDER BY abs(wi / hi - pw / CAST(ph AS DOUBLE)), o) AS rk
        FROM (SELECT DISTINCT pw, ph FROM f7_px WHERE ph > 0) CROSS JOIN {PAPER}) WHERE rk = 1) ON ew = pw AND eh = ph""", ("f7_px",))


def px_cases(spark, sf):
    d = cases(spark, sf)
    tag = F.when(Q("l_linenumber") % 4 == 0, 0.0).when(Q("l_linenumber") % 4 == 1, 96.0).when(Q("l_linenumber") % 4 == 2, Q("q") * 12).otherwise(72.4)
    return d.withColumns({"pw": (Q("l_partkey") % 3000).cast("int"), "ph": (Q("l_suppkey") % 97 * 40).cast("int"), "tag": tag})


@query("sca_23_estimate_dpi", "f7_est", f"SELECT {K}, est AS dpi FROM f7_est")
def _(spark, sf):
    return out(px_cases(spark, sf), dpi=G.estimate_dpi(Q("pw"), Q("ph")))


view("f7_res", """
    SELECT *, CASE WHEN bad THEN est ELSE tx END AS dx, CASE WHEN bad THEN est ELSE 300 END AS dy
    FROM (SELECT *, tx <= 1 OR (tx IN (96, 72) AND greatest(pw, ph) > 14 * tx + 50) AS bad
          FROM (SELECT *, CAST(round_even(CAST(tag AS DOUBLE), 0) AS INTEGER) AS tx FROM f7_est))""", ("f7_est",))


@query("sca_24_resolve_dpi", "f7_res", f"SELECT {K}, dx, dy FROM f7_res")
def _(spark, sf):
    dx, dy = G.resolve_dpi(Q("pw"), Q("ph"), Q("tag"), F.lit(300.0))
    return out(px_cases(spark, sf), dx=dx, dy=dy)


def limited_sql(size: str, dpi: str) -> str:
    return f"greatest(1, CAST(round_even({size} * (CASE WHEN {dpi} > 200 * CAST(1.02 AS DOUBLE) THEN CAST(200 AS DOUBLE) / {dpi} ELSE 1 END), 0) AS INTEGER))"


@query("sca_25_limited_size", "f7_res", f"SELECT {K}, {limited_sql('pw', 'dx')} AS lw, {limited_sql('ph', 'dy')} AS lh FROM f7_res")
def _(spark, sf):
    dx, dy = G.resolve_dpi(Q("pw"), Q("ph"), Q("tag"), F.lit(300.0))
    d = px_cases(spark, sf).withColumns({"dx": dx, "dy": dy})
    lw, lh = G.limited_size(Q("pw"), Q("ph"), Q("dx"), Q("dy"), 200)
    return out(d, lw=lw, lh=lh)


@query("sca_26_pdf_render_dpi", "f7", f"""
    SELECT {K}, CAST(CASE WHEN px > 36000000 THEN greatest(72, CAST(floor(e * sqrt(CAST(36000000 AS DOUBLE) / px)) AS INTEGER)) ELSE e END AS INTEGER) AS dpi
    FROM (SELECT *, w / CAST(72 AS DOUBLE) * e * (h / CAST(72 AS DOUBLE) * e) AS px FROM (
      SELECT *, CASE WHEN CAST(round_even(q * 13.3, 0) AS INTEGER) > 0 AND CAST(round_even(q * 13.3, 0) AS INTEGER) < 300 THEN CAST(round_even(q * 13.3, 0) AS INTEGER) ELSE 300 END AS e FROM f7))""")
def _(spark, sf):
    return out(cases(spark, sf), dpi=G.pdf_render_dpi(Q("w"), Q("h"), Q("q") * 13.3, 300))


@query("sca_36_page_layout", "f7", f"""
    SELECT {K}, round(CASE WHEN f THEN w * k ELSE pw END, 6) AS sheet_w, round(CASE WHEN f THEN h * k ELSE ph END, 6) AS sheet_h,
           round(CASE WHEN f OR fills THEN NULL ELSE (pw - iw) / 2 END, 6) AS ix, round(CASE WHEN f OR fills THEN NULL ELSE (ph - ih) / 2 END, 6) AS iy,
           round(CASE WHEN f OR fills THEN NULL ELSE iw END, 6) AS iw, round(CASE WHEN f OR fills THEN NULL ELSE ih END, 6) AS ih
    FROM (SELECT *, abs(iw - pw) < 1 AND abs(ih - ph) < 1 AS fills FROM (SELECT *, w * fit AS iw, h * fit AS ih
      FROM (SELECT *, least(pw / w, ph / h) AS fit FROM (SELECT {K}, w, h, n % 3 = 0 AS f, CAST(841.89 AS DOUBLE) / greatest(w, h) AS k,
        CASE WHEN w > h THEN CAST(841.89 AS DOUBLE) ELSE CAST(595.276 AS DOUBLE) END AS pw, CASE WHEN w > h THEN CAST(595.276 AS DOUBLE) ELSE CAST(841.89 AS DOUBLE) END AS ph
        FROM (SELECT {K}, n, CASE WHEN n % 2 = 0 THEN h ELSE w END AS w, CASE WHEN n % 2 = 0 THEN w - 1000 ELSE CAST(round_even(w * 1.41421356237, 0) AS INTEGER) END AS h FROM f7)))))""")
def _(spark, sf):
    from folio.functions.layout import page_layout
    d = cases(spark, sf).withColumns({"pw": F.when(Q("n") % 2 == 0, Q("h")).otherwise(Q("w")),
                                      "ph": F.when(Q("n") % 2 == 0, Q("w") - 1000).otherwise(F.rint(Q("w") * 1.41421356237).cast("int"))})
    cols = page_layout(Q("pw"), Q("ph"), Q("n") % 3 == 0)
    return out(d, **cols)


@query("sca_41_stamp", "f7", f"""
    SELECT {K}, round(CASE tt WHEN 1 THEN 1 - sy WHEN 2 THEN 1 - sx WHEN 3 THEN sy ELSE sx END, 6) AS cx,
           round(CASE tt WHEN 1 THEN sx WHEN 2 THEN 1 - sy WHEN 3 THEN 1 - sx ELSE sy END, 6) AS cy, (n + tt) % 4 AS turns,
           CASE WHEN (n + tt) % 4 % 2 = 1 THEN hh ELSE ww END AS fw, CASE WHEN (n + tt) % 4 % 2 = 1 THEN ww ELSE hh END AS fh
    FROM (SELECT *, ww0 AS ww, ww0 * 40 / 160 AS hh FROM (
      SELECT *, ((deg // 90) % 4 + 4) % 4 AS tt, d * 5 AS sx, t * 8 AS sy, (q / 100) * least(w, h) AS ww0 FROM f7))""")
def _(spark, sf):
    from folio.functions.stamps import stamp_footprint, stamp_rotate
    d = cases(spark, sf).withColumn("turn", F.pmod((Q("deg") / 90).cast("int"), F.lit(4)))
    cx, cy, turns = stamp_rotate(Q("d") * 5, Q("t") * 8, Q("n"), Q("turn"))
    d = d.withColumns({"cx": cx, "cy": cy, "turns": turns})
    fw, fh = stamp_footprint(Q("q") / 100, Q("turns"), F.lit(160), F.lit(40), Q("w"), Q("h"))
    return out(d, cx=Q("cx"), cy=Q("cy"), turns=Q("turns"), fw=fw, fh=fh)


@query("sca_44_distances", "f7", f"""
    SELECT {K}, round(greatest({', '.join(f'sqrt((x{i}-u{i})*(x{i}-u{i})+(y{i}-v{i})*(y{i}-v{i}))' for i in range(4))}), 6) AS moved,
           round(least(dd, pi() - dd), 6) AS angle FROM (SELECT *, CASE WHEN dd0 >= pi() THEN dd0 - pi() ELSE dd0 END AS dd FROM (
             SELECT *, abs(l_partkey % 180 * pi() / 180 - l_suppkey % 180 * pi() / 180) AS dd0 FROM f7))""")
def _(spark, sf):
    import math
    a, b = Q("l_partkey") % 180 * math.pi / 180, Q("l_suppkey") % 180 * math.pi / 180
    return out(cases(spark, sf), moved=G.quad_distance(Q("quad"), Q("quad2")), angle=G.angle_diff(a, b))


@query("sca_44_signature_distance", "f2", """
    SELECT a.image_id AS vec_id, round(sum(abs(a.v - b.v)) / 64.0, 6) AS distance FROM f2 a JOIN f2 b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.image_id""")
def _(spark, sf):
    s = T.tile_signatures(spark, sf)
    nxt = s.select((Q("vec_id") - 1).alias("vec_id"), Q("sig").alias("next_sig"))
    return s.join(nxt, "vec_id").select("vec_id", F.round(signature_distance(Q("sig"), Q("next_sig")), 6).alias("distance"))


def clip_sql() -> str:
    """Visible area ny1 triangles' signed clipped columns is hard in SQL; grow the outline instead and
    clip it edge ny1 edge with unnested points."""
    steps = [("x", "0", ">="), ("x", "fw", "<="), ("y", "0", ">="), ("y", "fh", "<=")]
    cur = "clip0"
    sql = [f"clip0 AS (SELECT rid, {K}, fw, fh, unnest([1,2,3,4]) AS o, unnest([x0,x1,x2,x3]) AS x, unnest([y0,y1,y2,y3]) AS y FROM shifted)"]
    for i, (ax, lim, op) in enumerate(steps):
        nxt = f"clip{i + 1}"
        sql.append(f"""{nxt}n AS (SELECT *, coalesce(lead(x) OVER p, first_value(x) OVER p) AS nx1, coalesce(lead(y) OVER p, first_value(y) OVER p) AS ny1 FROM {cur} WINDOW p AS (PARTITION BY rid ORDER BY o)),
    {nxt}u AS (SELECT rid, {K}, fw, fh, o * 2 AS o, x, y FROM {nxt}n WHERE {ax} {op} {lim}
      UNION ALL SELECT rid, {K}, fw, fh, o * 2 + 1, x + (nx1 - x) * (({lim} - {ax}) / (n{ax}1 - {ax})), y + (ny1 - y) * (({lim} - {ax}) / (n{ax}1 - {ax})) FROM {nxt}n WHERE ({ax} {op} {lim}) <> (n{ax}1 {op} {lim})),
    {nxt} AS (SELECT rid, {K}, fw, fh, row_number() OVER (PARTITION BY rid ORDER BY o) AS o, x, y FROM {nxt}u)""")
        cur = nxt
    return ",\n".join(sql)


view("shifted", f"SELECT *, row_number() OVER () AS rid, w * (1 - d) AS fw, h * (1 - t) AS fh FROM (SELECT * REPLACE (x0 - w * 2 * d AS x0, x1 - w * 2 * d AS x1, x2 - w * 2 * d AS x2, x3 - w * 2 * d AS x3) FROM f7)", ("f7",))


@query("sca_49_outline_rules", "shifted", f""",
    {clip_sql()}, seen AS (SELECT rid, abs(sum(x * ny - nx * y)) / 2 AS area FROM (
       SELECT rid, x, y, coalesce(lead(x) OVER p, first_value(x) OVER p) AS nx, coalesce(lead(y) OVER p, first_value(y) OVER p) AS ny FROM clip4 WINDOW p AS (PARTITION BY rid ORDER BY o)) GROUP BY rid)
    SELECT {K}, round(coalesce(area, 0), 3) AS visible_area, round(greatest({', '.join(
        f"abs(acos(least(greatest(((x{(i+3)%4}-x{i})*(x{(i+1)%4}-x{i})+(y{(i+3)%4}-y{i})*(y{(i+1)%4}-y{i}))/({d_sql((i+3)%4, i)}*{d_sql((i+1)%4, i)}+1e-12),-1),1))-pi()/2)" for i in range(4))}), 6) AS deviation,
        {' AND '.join(f"x{i} >= -(w*0.04::DOUBLE) AND y{i} >= -(w*0.04::DOUBLE) AND x{i} <= fw-1+w*0.04::DOUBLE AND y{i} <= fh-1+w*0.04::DOUBLE" for i in range(4))} AS inside,
        round(least({d_sql(0, 1)}, {d_sql(1, 2)}, {d_sql(2, 3)}, {d_sql(3, 0)}), 6) AS min_side,
        round(CASE WHEN abs(cos(ta)*sin(tb)-sin(ta)*cos(tb)) < 0.3 THEN NULL ELSE ((q*10)*sin(tb)-sin(ta)*(q*20))/(cos(ta)*sin(tb)-sin(ta)*cos(tb)) END, 3) AS ix
    FROM (SELECT *, l_partkey % 180 * pi() / 180 AS ta, l_suppkey % 180 * pi() / 180 AS tb FROM shifted) LEFT JOIN seen USING (rid)""")
def _(spark, sf):
    import math
    d = cases(spark, sf).withColumn("quad", F.array(*[Q("quad")[i] - (Q("w") * 2 * Q("d") if i % 2 == 0 else F.lit(0.0)) for i in range(8)]))
    d = d.withColumns({"fw": Q("w") * (1 - Q("d")), "fh": Q("h") * (1 - Q("t"))})
    d = G.with_visible_area(d, "quad", "fw", "fh")
    ix, _ = G.intersect(Q("l_partkey") % 180 * math.pi / 180, Q("q") * 10, Q("l_suppkey") % 180 * math.pi / 180, Q("q") * 20)
    return out(d, 6, visible_area=F.round("visible_area", 3), deviation=G.max_angle_deviation(Q("quad")), inside=G.inside_frame(Q("quad"), Q("fw"), Q("fh"), Q("w") * 0.04),
               min_side=G.min_side(Q("quad")), ix=F.round(ix, 3))


# --- overlap of outlines -----------------------------------------------------------

view("p_quads", """
    SELECT p_partkey AS case_id, 68 AS gw, 120 AS gh, CAST(20 + p_size AS DOUBLE) AS x0, CAST(30 + p_size % 7 * 3 AS DOUBLE) AS y0, CAST(250 - p_size AS DOUBLE) AS x1, CAST(40 + p_size % 5 * 4 AS DOUBLE) AS y1,
           CAST(240 - p_size % 11 * 2 AS DOUBLE) AS x2, CAST(440 - p_size AS DOUBLE) AS y2, CAST(30 + p_size % 13 AS DOUBLE) AS x3, CAST(430 - p_size % 9 * 5 AS DOUBLE) AS y3,
           CAST(p_partkey % 40 AS DOUBLE) AS sh FROM part""")


@query("join_12_quad_iou", "p_quads", f"""
    SELECT case_id, count(*) FILTER (WHERE a AND b) AS inter, count(*) FILTER (WHERE a OR b) AS uni,
           round(CASE WHEN count(*) FILTER (WHERE a OR b) = 0 THEN 0 ELSE count(*) FILTER (WHERE a AND b) / CAST(count(*) FILTER (WHERE a OR b) AS DOUBLE) END, 6) AS iou
    FROM (SELECT case_id, {contains_sql('gx', 'gy')} AS a, {contains_sql('(gx - sh)', '(gy - sh / 2)')} AS b
          FROM p_quads CROSS JOIN (SELECT CAST(unnest(range(0, 272, 4)) AS DOUBLE) AS gx) CROSS JOIN (SELECT CAST(unnest(range(0, 480, 4)) AS DOUBLE) AS gy)) GROUP BY case_id""")
def _(spark, sf):
    from folio.operators.outline import quad_iou
    return quad_iou(part_quads(spark, sf), 272, 480)


def part_quads(spark, sf):
    p = T.read(spark, sf, "part")
    s, dbl = Q("p_size"), lambda c: c.cast("double")
    quad = F.array(dbl(20 + s), dbl(30 + s % 7 * 3), dbl(250 - s), dbl(40 + s % 5 * 4), dbl(240 - s % 11 * 2), dbl(440 - s), dbl(30 + s % 13), dbl(430 - s % 9 * 5))
    d = p.select(Q("p_partkey").alias("case_id"), quad.alias("quad"), dbl(Q("p_partkey") % 40).alias("sh"))
    return d.select("case_id", "quad", F.transform("quad", lambda v, i: v + F.when(i % 2 == 0, Q("sh")).otherwise(Q("sh") / 2)).alias("quad2"))


def cyc(r: int) -> str:
    return "greatest(" + ", ".join(f"sqrt((x{i}-gx{(i+r)%4})*(x{i}-gx{(i+r)%4})+(y{i}-gy{(i+r)%4})*(y{i}-gy{(i+r)%4}))" for i in range(4)) + ")"


@query("join_12_corner_error", "f7", f"""
    SELECT {K}, round(least({', '.join(cyc(r) for r in range(4))}) / sqrt(CAST(w AS DOUBLE) * w + CAST(h AS DOUBLE) * h), 6) AS error FROM (
      SELECT *, {', '.join(f"least(greatest(u{i}, 0), CAST(w AS DOUBLE)) AS gx{i}, least(greatest(v{i}, 0), CAST(h AS DOUBLE)) AS gy{i}" for i in range(4))} FROM f7)""")
def _(spark, sf):
    from folio.operators.outline import corner_error
    d = cases(spark, sf)
    return out(d, error=corner_error(Q("quad"), Q("quad2"), Q("w"), Q("h")))
