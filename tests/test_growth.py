"""Work that has to grow no faster than the tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.operators import outline as OL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_is_counted_without_a_row_per_grid_point(spark):
    q = [10.0, 12.0, 90.0, 8.0, 95.0, 70.0, 4.0, 66.0]
    rows = [(0, q, [v + 4 for v in q]), (1, q, q[2:] + q[:2]), (2, q, None), (3, q, q[:7] + [None]), (4, [8.0] * 8, q),
            (5, q, [90.0, 8.0, 10.0, 12.0, 95.0, 70.0, 4.0, 66.0]), (6, [float("nan")] * 8, q)]
    d = spark.createDataFrame(rows, "case_id int, quad array<double>, quad2 array<double>")
    got = OL.quad_iou(d, 100, 80)
    assert "Generate" not in plan(got)
    grid = d.join(spark.range(0, 100, 4).select(F.col("id").cast("double").alias("x"))).join(spark.range(0, 80, 4).select(F.col("id").cast("double").alias("y")))
    a, b = (G.quad_contains(F.col(c), F.col("x"), F.col("y")) for c in ("quad", "quad2"))
    want = grid.groupBy("case_id").agg(F.count_if(a & b).alias("inter"), F.count_if(a | b).alias("uni"))
    assert sorted(got.select("case_id", "inter", "uni").collect()) == sorted(want.collect())


def test_corners_are_computed_once_per_candidate(spark):
    line = "image_id bigint, w int, h int, line_id string, theta double, rho double, votes double, is_border boolean, strength double"
    d = OL.outline_candidates(OL.line_pairs(spark.createDataFrame([(1, 480, 360, "a", 0.1, 40.0, 9.0, False, 20.0)], line)))
    p = d._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bCOS\(", p)) <= 8  # where the lines are read, none in a rule on corners


@pytest.mark.parametrize("name", ["join_09_warp", "join_09_curved_warp"])
def test_sources_of_both_densities_agree_with_sql(spark, name):
    from folio import checks
    from harness import compare, duck
    sf = "/root/testdata/sf0.1"  # from picture 11 on there are sources that are read at one position
    queries, oracles = checks.load()
    assert compare(spark, duck(sf), name, queries[name], oracles[name], sf)[0].startswith("ok 32")


def test_a_batch_of_pages_holds_bytes_not_words(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa
    from folio.operators import scanlines as SL
    caught = []
    monkeypatch.setattr(SL.F, "arrow_udf", lambda run, returnType: caught.append(run) or (lambda *cols: None))
    monkeypatch.setattr(SL.F, "struct", lambda *cols: None)
    SL.per_page(lambda p: p.astype("int64"), SL.BYTES)(*[F.lit(1)] * 3)
    vals, args = pa.array([bytes(250_000)] * 64), pa.array([{"w": 500, "h": 500}] * 64)
    tracemalloc.start()
    caught[0](vals, args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 64 * 250_000  # eight times as much where the kernel's words are kept


def test_listed_files_are_not_made_distinct_for_a_semi_join(spark):
    from folio.operators.references import with_existing_source
    a, b = (spark.createDataFrame([("A/1.jpg",), ("a/1.JPG",)], "path string") for _ in range(2))
    got = with_existing_source(a, b)
    assert "HashAggregate" not in plan(got) and got.count() == 2


@pytest.mark.parametrize("name", ["join_03_unreferenced_files", "join_05_missing_sources"])
def test_listed_files_are_not_shuffled(spark, sf, name):
    from folio import checks
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(checks.load()[0][name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\((\w+)", p)
    assert keys and not {"lower", "path", "_p"} & set(keys), keys


def test_references_to_a_listing_equal_those_to_its_files(spark):
    from folio.operators import references as R
    names = spark.createDataFrame([("1.jpg", 1), ("1.JPG", 1), ("2.jpg", 2), ("2.jpg", 2), ("3.jpg", 1), ("3.jpg", 2), (None, 1), ("4.jpg", None), ("5.jpg", 1)], "name string, shelf long")
    folders = spark.createDataFrame([("A/", 1), ("a/", 2), ("a/b/", 1), ("", 2), ("C/", None), (None, 1)], "folder string, shelf long")
    paths = ["a/1.jpg", "A/2.JPG", "a/B/3.jpg", "a/B/3.jpg", "2.jpg", "a/4.jpg", "c/1.jpg", "gone/1.jpg", "a/b/", "", None]
    a, b = (spark.createDataFrame([(i, p) for i, p in enumerate(x)], "page_id int, path string") for x in (paths[:5], paths))
    files = R.listed(names, folders)
    rows = lambda d: sorted(d.collect(), key=repr)
    for versions in ([a], [a, b], [b.limit(0)]):
        v = [x.select("path") for x in versions]
        got = rows(R.unreferenced_listed(names, folders, v))
        assert got and got == rows(R.unreferenced(files, v))
    assert rows(R.with_listed_source(b, names, folders)) == rows(R.with_existing_source(b, files))


def batches_of(d, batch):
    """A stand-in for ``d``, and what the function it is mapped with sends for an Arrow batch: rows and bytes of each batch."""
    caught = []

    class Caught:
        schema, columns = d.schema, d.columns

        def mapInArrow(self, run, schema):
            caught.append(run)

    return Caught(), lambda: [(b.num_rows, b.nbytes) for b in caught[0](iter([batch]))]


def test_sheets_drawn_leave_in_small_batches(spark, sf, monkeypatch):
    import pyarrow as pa
    from folio.sources import tables as T
    d = T.sheet_outlines(spark, sf)
    caught, sent = batches_of(d, pa.Table.from_pylist([r.asDict() for r in d.limit(1).collect()] * 40).combine_chunks().to_batches()[0])
    monkeypatch.setattr(T, "by_image", lambda d: caught)
    T.sheet_pages(spark, sf)
    got = sent()
    assert sum(n for n, _ in got) == 40 and max(b for _, b in got) < 20e6  # 37 MB together


def test_an_outline_is_refined_in_one_worker_a_task(spark, sf):
    from folio import checks
    p = plan(checks.load()[0]["img_09_refine_outline"](spark, sf))
    assert "ArrowEvalPython" not in p and len(re.findall(r"MapInArrow", p.split("Initial Plan")[0])) == 2  # drawn, refined


def test_local_statistics_leave_in_small_batches(spark):
    import numpy as np
    import pyarrow as pa
    from folio.operators import scanlines as SL
    rows = [(k, 500, 100, bytes(range(250)) * 200) for k in range(60)] + [(60, 500, 100, None), (61, 0, 0, b"")]
    d = spark.createDataFrame(rows, "image_id long, w int, h int, vals binary").coalesce(1)
    caught, sent = batches_of(d, pa.RecordBatch.from_pylist([dict(zip(d.columns, r)) for r in rows], schema=pa.schema([("image_id", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("vals", pa.binary())])))
    SL.local_stats(caught, 5)
    got = sent()
    assert [n for n, _ in got] == [21, 21, 20] and max(b for _, b in got) < 20e6  # 51 MB together
    whole = {r.image_id: r for r in SL.local_stats(d, 5).collect()}
    mean, variance = SL._stats(np.frombuffer(rows[0][3], np.uint8).reshape(100, 500), 5)
    assert len(whole) == 62 and all(whole[k].mean == mean.ravel().tolist() and whole[k].variance == variance.ravel().tolist() for k in (0, 20, 21, 59))
    assert whole[60].mean is None and whole[60].variance is None and whole[61].mean == []


def test_outlines_are_made_of_pairs_without_a_join(spark, sf):
    from folio import checks
    p = plan(checks.load()[0]["top_06_pick_outline"](spark, sf))
    assert "Join" not in p


def test_combined_pairs_equal_a_row_per_combination(spark, sf, monkeypatch):
    from folio.checks import outlines as O
    odd = [(10**9, 480, 360, n, t, r, 9.0, False, 20.0) for n, t, r in (("a", 0.0, 40.0), ("b", 0.0, 440.0), (None, 0.0, 300.0), ("b", 0.01, 400.0),
           ("c", 1.6, 30.0), ("d", 1.5, 300.0), ("e", None, 9.0), ("f", 1.55, None), ("g", float("nan"), 5.0), ("h", 1.55, float("inf")))]
    line = "image_id bigint, w int, h int, line_id string, theta double, rho double, votes double, is_border boolean, strength double"
    pairs = OL.line_pairs(O.ol_lines(spark, sf).filter("image_id < 300").unionByName(spark.createDataFrame(odd + [(10**9, 480, 360, "i", 1.5, 200.0, 9.0, None, 20.0)], line))).localCheckpoint()
    p, q = pairs.selectExpr("image_id", "w", "h", "a pa", "b pb"), pairs.selectExpr("image_id", "a qa", "b qb")
    d = p.join(q, "image_id").filter("struct(pa.line_id, pb.line_id) < struct(qa.line_id, qb.line_id)")
    for s, t in ((s, t) for s in ("pa", "pb") for t in ("qa", "qb")):
        d = d.filter((G.angle_diff(F.col(f"{s}.theta"), F.col(f"{t}.theta")) >= OL.MIN_CROSSING) & (F.col(f"{s}.line_id") != F.col(f"{t}.line_id")))
    d = d.filter("int(pa.is_border) + int(pb.is_border) + int(qa.is_border) + int(qb.is_border) <= 2")
    corner = lambda s, t: list(G.crossing(*[F.col(f"{x}.{c}") for x in (s, t) for c in ("cos", "sin", "rho")]))
    d = d.withColumn("quad", F.array(*corner("pa", "qa"), *corner("pa", "qb"), *corner("pb", "qb"), *corner("pb", "qa"))).localCheckpoint()
    monkeypatch.setattr(OL, "COMBINED", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for margin in (OL.NEAR_MARGIN, 0.25):
            reach = (F.least if margin > OL.NEAR_MARGIN else F.greatest)("w", "h") * margin
            want = G.with_visible_area(d.filter(OL.plausible_outline(F.col("quad"), F.col("w"), F.col("h"), reach)), "quad", "w", "h", "visible")
            want = sorted(want.selectExpr("image_id", "array(pa.line_id, qb.line_id, pb.line_id, qa.line_id) s", "quad", "visible").collect())
            got = OL.outline_candidates(pairs, margin).selectExpr("image_id", "sides.line_id s", "quad", "visible").collect()
            assert sorted(got) == want and 10**9 in {r.image_id for r in got} and len({r.image_id for r in got}) > 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
