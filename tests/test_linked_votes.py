"""Votes, peaks and refitted lines of the registered queries come from all linked edges."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from folio import checks
from folio.checks import outlines
from folio.operators import edges as E


def flooded(thin):
    """Plain flood fill from strong pixels over weak ones: image -> {(y, x): (theta, mag)}."""
    pictures = defaultdict(dict)
    for r in thin:
        a = math.atan2(r.gy, r.gx)
        a = a + math.pi if a < 0 else a
        pictures[r.image_id][r.y, r.x] = (a - math.pi if a >= math.pi else a, math.sqrt(r.m2) / E.UNIT)
    for i, p in pictures.items():
        high = max(E.EDGE_FLOOR, min(m for _, m in p.values()))
        low = max(E.EDGE_FLOOR * 0.5, high * 0.4)
        todo = [k for k, (_, m) in p.items() if m >= high]
        on = set(todo)
        while todo:
            y, x = todo.pop()
            for k in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if k in p and k not in on and p[k][1] >= low:
                    on.add(k)
                    todo.append(k)
        pictures[i] = {k: p[k] for k in on}
    return pictures


def test_votes_peaks_and_lines_read_linked_edges(spark):
    sf = "/root/testdata/sf0.1"  # the smaller ones hold no weak pixel on a strong one
    queries, _ = checks.load()
    pictures = flooded(E.thin(E.gradients(outlines.epx(spark, sf))).collect())
    assert len({i for i, p in pictures.items() for _, m in p.values() if m < E.EDGE_FLOOR}) > 0  # weak pixels take part
    by_theta, pixels, votes = Counter(), Counter(), Counter()
    for i, p in pictures.items():
        for (y, x), (theta, mag) in p.items():
            for d in range(-3, 4):
                t, wt = (round(theta * 180 / math.pi) % 180 + d) % 180, 1 + int(min(mag, 48)) // 4
                by_theta[i, t] += wt
                pixels[i, t] += 1
                votes[i, t, round(x * math.cos(math.radians(t)) + y * math.sin(math.radians(t)))] += wt
    assert {(r.image_id, r.t): (r.pixels, r.weight) for r in queries["join_16_linked_edge_by_theta"](spark, sf).collect()} == {k: (pixels[k], n) for k, n in by_theta.items()}
    assert {(r.image_id, r.t, r.rho): r.votes for r in queries["agg_13_linked_hough_votes"](spark, sf).collect()} == votes
    want = {}
    for i in pictures:
        cells, k = {c[1:]: n for c, n in votes.items() if c[0] == i and n >= 40}, 0
        for (t, rho), n in sorted(cells.items(), key=lambda c: (-c[1], c[0])):
            if (t, rho) not in cells:
                continue
            want[i, k] = (t, rho, n)
            k += 1
            near = lambda c: (abs(c[0] - t) <= 4 and abs(c[1] - rho) <= 6) or (abs(c[0] - t) >= 176 and abs(c[1] + rho) <= 6)  # noqa: B023, E731
            cells = {c: v for c, v in cells.items() if not near(c)}
    assert {(r.image_id, r.rank): (r.t, r.rho, r.votes) for r in queries["top_03_hough_peaks"](spark, sf).collect()} == want
    found = E.refit_lines(E.hough_peaks(E.hough_votes(outlines.linked(spark, sf))), outlines.linked(spark, sf)).collect()
    lines = {(r.image_id, r.rank): r.votes for r in queries["agg_14_line_refit"](spark, sf).collect()}
    assert lines == {(r.image_id, r.rank): r.votes for r in found} and set(lines) == set(want)
