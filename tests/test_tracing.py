"""Outlines on picture rows against the operators on a row per pixel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_outlines import QUADS, rgb_of, scene

from folio import checks
from folio.operators import edges as E
from folio.operators import support as SU
from folio.operators import tracing as TR


def test_no_pixel_becomes_a_row(spark, sf, monkeypatch):
    kept, checkpointed = [], SU.checkpointed
    monkeypatch.setattr(SU, "checkpointed", lambda d: kept.append(d.columns) or checkpointed(d))
    checks.load()[0]["img_08_live_outline"](spark, sf)
    assert kept and not any("x" in c or "theta" in c and "line_id" not in c for c in kept)


def test_rows_that_no_side_spans_have_no_inside(spark):
    quad = [20.5, 9.6, 60.0, 3.4, 58.0, 50.0, 22.0, 48.0]  # no side reaches row 3
    frame = scene(1, QUADS[1], w=80, h=60)
    c = spark.createDataFrame([(1, 80, 60, 5, quad, [False] * 4)], "image_id long, w int, h int, cand_id long, quad array<double>, border array<boolean>")
    got = SU.interior_colors(c, rgb_of(spark, [frame])).first()
    p = frame[["r", "g", "b"]].to_numpy(np.uint8).reshape(60, 80, 3)
    paper, mean = TR._inside_colours(p, p.astype(int) @ (299, 587, 114) // 1000, np.array(quad).reshape(4, 2), SU.PAPER_SHARE)
    q, seen = np.array(quad).reshape(4, 2), []
    for y in range(3, 51, 3):
        x = [a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in zip(q, np.roll(q, -1, axis=0)) if min(a[1], b[1]) <= y <= max(a[1], b[1])]
        seen += [p[y, k] for k in range(int(np.ceil(min(x))), int(np.floor(max(x))) + 1, 3)] if x else []
    assert mean == pytest.approx(np.mean(seen, 0)) and tuple(got.mean) == pytest.approx(tuple(mean)) and tuple(got.paper) == pytest.approx(tuple(paper))


def test_edges_lines_and_scores_equal_the_row_form(spark):
    frames = [scene(i, q, seed=i) for i, q in QUADS.items() if i != 2]
    rgb = rgb_of(spark, frames).cache()
    edges = E.linked_edges(E.thin(E.gradients(rgb))).cache()
    pages = {r.image_id: np.frombuffer(r.vals, np.uint8).reshape(r.h, r.w, 3) for r in TR.pictures(rgb).collect()}
    mine = {i: TR._edges(p) for i, p in pages.items()}
    want = {(r.image_id, r.y * r.w + r.x): (r.theta, r.mag) for r in edges.collect()}
    assert {(i, int(k)): pytest.approx((t, m)) for i, e in mine.items() for k, t, m in zip(e["at"], e["theta"], e["mag"])} == want
    lines = {(r.image_id, r["rank"]): r for r in E.distinct_lines(E.refit_lines(E.hough_peaks(E.hough_votes(edges)), edges)).collect()}
    found = {(i, s["rank"]): s for i, e in mine.items() for s in TR._lines(e, 168, 132, None)}
    assert found.keys() == lines.keys()
    for k, s in found.items():
        assert [s[c] for c in ("theta", "rho", "votes", "strength")] == pytest.approx([lines[k][c] for c in ("theta", "rho", "votes", "strength")]), k
    cands = [(i, 168, 132, k, [float(v + d) for v in QUADS[i]], [False, False, False, i == 3]) for i in (1, 3) for k, d in enumerate((0, 0.3, 2, 5))]
    c = spark.createDataFrame(cands, "image_id long, w int, h int, cand_id long, quad array<double>, border array<boolean>")
    sides = {(r.image_id, r.cand_id): r for r in SU.side_supports(c, edges, rgb).groupBy("image_id", "cand_id").agg(
        *[F.sort_array(F.collect_list(F.struct("side", n)))[f"{n}"].alias(n) for n in ("support", "edge_fraction")], F.avg("edge_strength").alias("strength")).collect()}
    for i, _, _, k, quad, border in cands:
        probe = TR._Probe(pages[i], mine[i])
        s = probe.along(quad, border)
        support, strength = probe.support(s)
        row = sides[i, k]
        assert support == pytest.approx(row.support) and s["fraction"] == pytest.approx(row.edge_fraction) and strength == pytest.approx(row.strength)
