"""Outlines of drawn sheets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from folio.operators import support as SU


def inside(quad, w, h):
    ys, xs = np.mgrid[0:h, 0:w]
    p = np.array(quad).reshape(4, 2)
    ok = np.ones((h, w), bool)
    for i in range(4):
        (ax, ay), (bx, by) = p[i], p[(i + 1) % 4]
        ok &= (bx - ax) * (ys - ay) - (by - ay) * (xs - ax) >= 0
    return ok


def scene(image_id, quad, w=168, h=132, table=(70, 60, 50), paper=(235, 232, 225), seed=1, lines=True):
    rng = np.random.default_rng(seed)
    img = np.empty((h, w, 3))
    img[:] = table
    on = inside(quad, w, h)
    img[on] = paper
    if lines:  # rows of text well inside
        ys, xs = np.mgrid[0:h, 0:w]
        inner = inside(np.array(quad) * 0.7 + 0.3 * np.tile(np.array(quad).reshape(4, 2).mean(0), 4), w, h)
        img[inner & (ys % 7 == 0) & (xs % 9 < 6)] = (60, 60, 60)
    img = np.clip(img + rng.normal(0, 2, img.shape), 0, 255).astype(int)
    ys, xs = np.mgrid[0:h, 0:w]
    return pd.DataFrame({"image_id": image_id, "w": w, "h": h, "y": ys.ravel(), "x": xs.ravel(), "r": img[..., 0].ravel(), "g": img[..., 1].ravel(), "b": img[..., 2].ravel()})


QUADS = {1: [30, 20, 140, 24, 136, 112, 26, 108], 2: [40, 14, 120, 26, 128, 118, 24, 104], 3: [0, 20, 120, 18, 124, 110, 0, 112]}


def rgb_of(spark, frames):
    return spark.createDataFrame(pd.concat(frames)).selectExpr(
        "cast(image_id as long) image_id", *[f"cast({c} as int) {c}" for c in ("w", "h", "y", "x", "r", "g", "b")])


def test_drawn_sheets_are_found(spark):
    blank = scene(9, QUADS[1], table=(200, 200, 200), paper=(200, 200, 200), lines=False)
    tiny = blank[(blank.x < 20) & (blank.y < 20)].assign(image_id=8, w=20, h=20)
    rgb = rgb_of(spark, [*(scene(i, q, seed=i) for i, q in QUADS.items()), blank, tiny])
    got = {r.image_id: r for r in SU.detect_outline(rgb, most_lines=8).collect()}
    assert set(got) == {1, 2, 3, 8, 9}
    for i, quad in QUADS.items():
        assert got[i].found and 0.42 <= got[i].confidence <= 1, got[i]
        q = np.array(got[i].quad).reshape(4, 2) * (168, 132) - 0.5
        a, b = inside(q.ravel(), 168, 132), inside(quad, 168, 132)
        assert (a & b).sum() / (a | b).sum() >= 0.92, (i, q)
    for i in (8, 9):
        assert not got[i].found and got[i].quad == pytest.approx([0.03, 0.03, 0.97, 0.03, 0.97, 0.97, 0.03, 0.97])


def test_paper_and_mean_colours(spark):
    frame = scene(1, QUADS[1])
    c = spark.createDataFrame([(1, 168, 132, 5, [float(v) for v in QUADS[1]], [False] * 4)], "image_id long, w int, h int, cand_id long, quad array<double>, border array<boolean>")
    got = SU.interior_colors(c, rgb_of(spark, [frame])).first()
    assert got.paper.r == pytest.approx(235, abs=4) and got.mean.r < got.paper.r
    y0 = 20
    at = frame[inside(QUADS[1], 168, 132).ravel()]
    assert got.mean.g == pytest.approx(at[(at.y - y0) % 3 == 0].g.mean(), abs=3)


def test_sides_on_edges_are_backed_and_others_are_not(spark):
    from folio.operators import edges as E
    rgb = rgb_of(spark, [scene(1, QUADS[1])])
    off = [60, 45, 110, 47, 108, 85, 58, 83]
    c = spark.createDataFrame([(1, 168, 132, k, [float(v) for v in q], [False] * 4) for k, q in enumerate((QUADS[1], off))],
                              "image_id long, w int, h int, cand_id long, quad array<double>, border array<boolean>")
    edges = E.linked_edges(E.thin(E.gradients(rgb)))
    rows = SU.side_supports(c, edges, rgb).collect()
    assert len(rows) == 8 and all(r.support > 0.8 and r.edge_strength > 100 for r in rows if r.cand_id == 0)
    assert max(r.support for r in rows if r.cand_id == 1) < 0.6 and min(r.support for r in rows if r.cand_id == 1) < 0.2
