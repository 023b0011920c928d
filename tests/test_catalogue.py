"""Names, splitting, ordering under skew, sources on real files, streams equal to their twins."""

from __future__ import annotations

import json
import random
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import naming as N
from folio.operators import catalogue as C
from folio.operators import ordered as O
from folio.sources import files as FS


def test_pattern_case(spark):
    ts = F.lit("2026-09-25 06:00:00").cast("timestamp")
    name = N.build_name("HD_{yyyy}-{MM}-{dd}_{counter}_{barcode}", ts, F.lit(7), F.lit("A/B"))
    assert spark.range(1).select(name).first()[0] == "HD_2026-09-25_007_A_B"


@pytest.mark.parametrize("name,query,expected", [
    ("Hợp đồng thuê nhà", "hop dong", True), ("Hợp đồng thuê nhà", "NHÀ hop", True), ("Hợp đồng thuê nhà", "hop xyz", False),
    ("Hóa đơn", "hoa don", True), ("anything", "  ", True), ("Đơn", "don", True)])
def test_search(spark, name, query, expected):
    assert spark.range(1).select(N.search(F.lit(name), query)).first()[0] is expected


def test_barcode_names_the_pages_after_it(spark):
    rows = [(1, 0, None, False), (1, 1, "SEP-INVOICE-42", False), (1, 2, None, False), (1, 3, None, False)]
    d = C.document_groups(spark.createDataFrame(rows, "batch_id int, pos long, barcode string, is_blank boolean"), "barcode", "sep-")
    assert sorted((r.pos, r.doc_no, r.doc_barcode) for r in d.collect()) == [(0, 1, None), (2, 2, "SEP-INVOICE-42"), (3, 2, "SEP-INVOICE-42")]


def test_split_loses_only_separators(spark):
    rows = [(1, i, None, i % 3 == 0) for i in range(20)]
    d = C.document_groups(spark.createDataFrame(rows, "batch_id int, pos long, barcode string, is_blank boolean"), "blank")
    assert sorted(r.pos for r in d.collect()) == [i for i in range(20) if i % 3]


def test_running_sums_over_a_hot_key(spark):
    """Two thirds of all rows share one key and cross many chunks."""
    d = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).alias("k"), F.col("id").alias("p"))
    got = O.running_sums(d, "k", O.block("p", 256), ["p"], {"n": F.lit(1).cast("bigint")})
    from pyspark.sql import Window
    want = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy("p")))
    assert got.select("k", "p", "n").exceptAll(want.select("k", "p", "n")).count() == 0


def test_unique_names_skip_taken_ones(spark):
    names = spark.createDataFrame([(i, "scan") for i in range(4)] + [(9, "other")], "id long, name string")
    taken = spark.createDataFrame([("Scan",), ("scan_3",), ("other_2",)], "name string")
    got = [r.unique_name for r in C.unique_names(names, taken, O.block("id"), ["id"]).orderBy("id").collect()]
    assert got == ["scan_2", "scan_4", "scan_5", "scan_6", "other"]


def test_unique_names_differ_from_suffixed_ones(spark):
    given = ["Scan", "Scan", "Scan_2", "scan_2", "Scan_2_2", "a_3", "a", "a", "a"]
    names = spark.createDataFrame(list(enumerate(given)), "id long, name string")
    for taken in (None, spark.createDataFrame([("A",)], "name string")):
        got = [r.unique_name for r in C.unique_names(names, taken, O.block("id"), ["id"]).orderBy("id").collect()]
        assert len({n.lower() for n in got}) == len(given) and got[:2] == ["Scan", "Scan_2"] and got[2].startswith("Scan_2_") and got[5] == "a_3"


def test_several_moves_and_restores_of_a_document(spark):
    pages = spark.createDataFrame([(d, f"{d}{c}", i) for d in (1, 2) for i, c in enumerate("abcde")], "doc_id long, page_id string, index long")
    moves = [(1, "1e", 0, 1), (1, "1a", 9, 2), (1, "1c", 1, 3), (2, "2b", 3, 1)]
    want = {d: [f"{d}{c}" for c in "abcde"] for d in (1, 2)}
    for d, p, to, _ in moves:
        want[d].remove(p)
        want[d].insert(max(0, min(to, 4)), p)
    got = C.move_pages(pages, spark.createDataFrame(moves, "doc_id long, page_id string, to long, seq long")).orderBy("doc_id", "new_index").collect()
    assert [r.page_id for r in got] == want[1] + want[2]
    rng = random.Random(5)
    many = [(1, f"p{rng.randrange(30)}", rng.randrange(-3, 40), k) for k in range(300)]
    order = [f"p{i}" for i in range(29)]
    book = spark.createDataFrame([(1, p, i) for i, p in enumerate(order)], "doc_id long, page_id string, index long")
    for _, p, to, _ in many:
        if p in order:  # there is no p29
            order.remove(p)
            order.insert(max(0, min(to, 28)), p)
    got = C.move_pages(book, spark.createDataFrame(many, "doc_id long, page_id string, to long, seq long")).orderBy("new_index").collect()
    assert [r.page_id for r in got] == order and [r.new_index for r in got] == list(range(29))
    left = pages.filter("page_id NOT IN ('1b', '1d', '1e', '2a')").withColumn("state", F.lit("Ready"))
    from pyspark.sql import Window
    left = left.withColumn("index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("index")) - 1).cast("long"))
    trash = spark.createDataFrame([(1, "1d", 3, "Ready"), (1, "1b", 1, "Importing"), (1, "1e", 4, "Ready"), (2, "2a", 0, "Ready")], "doc_id long, page_id string, index long, state string")
    back = C.restore_pages(left, trash).orderBy("doc_id", "new_index").collect()
    assert [(r.page_id, r.new_index) for r in back] == [(f"{d}{c}", i) for d in (1, 2) for i, c in enumerate("abcde")]
    assert {r.page_id: r.state for r in back}["1b"] == "Failed"


# --- files -------------------------------------------------------------------------

def png(path, rows, dpi=None):
    h, w = len(rows), len(rows[0])
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
    if dpi:
        body += chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1))
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures(spark, tmp_path):
    png(tmp_path / "a.png", [[0, 50, 255], [10, 20, 30]], 150)
    (tmp_path / "notes.txt").write_text("no")
    files = FS.read_page_files(spark, str(tmp_path))
    assert files.count() == 1
    info = FS.image_info(files).first()
    assert (info.w, info.h, info.dpi_x) == (3, 2, 150)
    rows = {r.y: list(r.vals) for r in FS.read_images(spark, str(tmp_path)).collect()}
    assert rows == {0: [0, 50, 255], 1: [10, 20, 30]}
    (tmp_path / "cut.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    states = {r.image_id.rsplit("/", 1)[1]: (r.w, r.h, r.state) for r in FS.image_states(spark, str(tmp_path / "*.png")).collect()}
    assert states == {"a.png": (3, 2, "Ready"), "cut.png": (None, None, "Failed")}


def test_catalogue_and_defaults(spark, tmp_path):
    for i, name in enumerate(("d1", "d2", "bad", "other")):
        (tmp_path / name).mkdir()
        doc = {"id": "moved" if name == "other" else name, "name": name, "createdUtc": f"2024-01-0{i + 1}T00:00:00Z", "pages": [{"id": "p1"}]}
        (tmp_path / name / "doc.json").write_text("{broken" if name == "bad" else json.dumps(doc))
    docs = FS.read_catalogue(spark, str(tmp_path))
    assert [r.id for r in docs.collect()] == ["d2", "d1"]
    p = FS.catalogue_pages(docs).first()
    assert (p.state, p.colorMode, p.bwDarkness) == ("Ready", "Color", 50)


def test_project(spark, tmp_path):
    (tmp_path / "project.xml").write_text('<ScanProject Version="2"><Pages><Page Id="a" File="x.png" Label="x"/>'
                                          '<Page Id="b" File="y.pdf" PdfPage="2" State="Pending" Crop="0.1,0.2,0.5,0.5"/></Pages></ScanProject>')
    r = {x.page_id: x for x in FS.read_project(spark, str(tmp_path / "project.xml")).collect()}
    assert (r["a"].pdf_page, r["a"].state) == (-1, "Ready")
    assert (r["b"].pdf_page, r["b"].state, r["b"].error, r["b"].crop) == (2, "Failed", "interrupted", [0.1, 0.2, 0.5, 0.5])


def test_words_signatures_and_log(spark, tmp_path):
    w = tmp_path / "words"
    w.mkdir()
    (w / "k1.json").write_text(json.dumps([{"Text": "hi", "X": 1, "Y": 2, "Width": 3, "Height": 4, "BaselineY": 5, "Confidence": 90.5}]))
    (w / "k2.json").write_text("{oops")
    assert [(r.key, r.text, r.x) for r in FS.read_ocr_words(spark, str(w)).collect()] == [("k1", "hi", 1)]
    log = tmp_path / "log.txt"
    log.write_text("10:00 INFO PERF proc.blank 12 ms\nproxy 7 ms\nstarted\n")
    assert sorted((r.name, r.ms) for r in FS.read_perf_log(spark, str(log)).collect()) == [("proc.blank", 12), ("proxy", 7)]


def test_versioned_save(spark, tmp_path):
    FS.write_catalogue(spark.range(3), str(tmp_path / "cat"), 1)
    FS.write_catalogue(spark.range(5), str(tmp_path / "cat"), 2)
    (tmp_path / "cat" / "v=000000000003").mkdir()  # a save that never finished
    assert FS.read_latest_version(spark, str(tmp_path / "cat")).count() == 5


# --- streams -----------------------------------------------------------------------

def run_stream(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def frames(spark):
    base = [0.2, 0.15, 0.8, 0.17, 0.82, 0.85, 0.18, 0.83]
    rows = []
    for s in (1, 2):
        for i in range(40):
            quad = None if 15 <= i < 21 else [v + (0.1 if i > 25 else 0) * (1 if k % 2 == 0 else 0) * 0.5 for k, v in enumerate(base)]
            rows.append((s, s * 1000 + i, i * 0.125, quad, 0.8, [100] * 64))
    return spark.createDataFrame(rows, "session_id long, event_id long, t double, quad array<double>, confidence double, sig array<int>")


def test_capture_stream_equals_batch(spark, tmp_path):
    from folio.streaming import capture as CP
    f = frames(spark)
    for i, part in enumerate((f.filter("event_id % 1000 < 17"), f.filter("event_id % 1000 >= 17"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    src = FS.frame_source(spark, str(tmp_path / "in" / "*"), f.schema)
    live = run_stream(spark, CP.capture_cues(src, live=True), tmp_path, "cues")
    batch = CP.capture_cues(f)
    a = sorted((r.session_id, r.event_id, r.cue) for r in live.collect())
    b = sorted((r.session_id, r.event_id, r.cue) for r in batch.collect())
    assert a == b
    cues = [c for s, _, c in b if s == 1]
    assert cues.index("Capture") in (7, 8) and cues[9] == "Captured" and "Searching" in cues and cues.count("Capture") == 2


def test_other_streams_equal_batch(spark, sf, tmp_path):
    from folio.sources import tables as T
    from folio.streaming import progress as PG
    for name, rows, fn in (("exports", T.export_events(spark, sf), PG.export_gates),
                           ("splits", T.batch_pages(spark, sf), lambda d, live=False: PG.stream_split(d, "SEP-a", live))):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
        live = run_stream(spark, fn(src, live=True), tmp_path, name)
        batch = fn(rows)
        assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_windowed_streams(spark, sf, tmp_path):
    from folio.sources import tables as T
    from folio.streaming import progress as PG
    p = T.perf_rows(spark, sf)
    p.coalesce(1).write.parquet(str(tmp_path / "perf"))
    src = spark.readStream.schema(p.schema).parquet(str(tmp_path / "perf"))
    live = run_stream(spark, PG.perf_windows(src, late="1 hour"), tmp_path, "perfwin")
    whole = PG.perf_windows(p)
    assert live.count() > 0 and live.exceptAll(whole).count() == 0  # the last open windows are still waiting


def test_ingest_writes_each_batch_once(spark, sf, tmp_path):
    from folio.sources import tables as T
    from folio.streaming import progress as PG
    d = T.read(spark, sf, "documents").select("doc_id", "n_chars")
    d.coalesce(1).write.parquet(str(tmp_path / "docs"))
    src = spark.readStream.schema(d.schema).parquet(str(tmp_path / "docs"))
    q = PG.incremental_ingest(src, lambda b: b.withColumn("long", F.col("n_chars") > 500), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == d.count()


def test_folders_signatures_and_renders(spark, tmp_path):
    (tmp_path / "folders.json").write_text(json.dumps([{"id": "f1", "name": "One"}, {"id": "f2", "name": "Two"}]))
    (tmp_path / "broken.json").write_text("[{")
    assert FS.read_folders(spark, str(tmp_path / "folders.json")).count() == 2
    assert FS.read_folders(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "ink.json").write_text(json.dumps([{"id": "a", "color": 255, "width": 4, "height": 2, "createdUtc": "2024-01-01T00:00:00Z"},
                                                  {"id": "b", "color": 1, "width": 4, "height": 2, "createdUtc": "2024-02-01T00:00:00Z"}]))
    assert [r.id for r in FS.read_signatures(spark, str(tmp_path / "ink.json")).collect()] == ["b", "a"]
    rows = [("d1", 1, rev, y, [0, 255]) for rev in (1, 2) for y in range(3)]
    d = spark.createDataFrame(rows, "doc_id string, image_id long, revision int, y int, vals array<int>")
    FS.write_pages(d, str(tmp_path / "out"))
    assert FS.read_pages(spark, str(tmp_path / "out")).filter("revision = 2").count() == 3
    back = spark.read.parquet(str(tmp_path / "out"))
    newest = C.latest(back.select("image_id", "revision").distinct(), "image_id", ["revision"]).first()
    assert back.count() == 6 and newest.revision == 2


def test_state_of_idle_keys_is_dropped(spark, tmp_path):
    import time

    from folio.streaming import state as ST
    schema = "k long, n long"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "idle" / name))
    put("a", [(1, 1), (2, 1)])
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "idle" / "*"))
    step = lambda s, r: ({"seen": s["seen"] + 1}, (s["seen"] + 1,))
    out = ST.stream(src, "k", "n", ["n"], step, {"seen": 0}, "k long, n long, seen long", ["seen"], idle_ms=1500)
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp_idle")).trigger(processingTime="1 second").start()
    rows = lambda: sorted((r.k, r.n, r.seen) for r in spark.table("idle").collect())
    held = lambda: [op["numRowsTotal"] for op in (q.lastProgress or {"stateOperators": []})["stateOperators"]]

    def until(done):
        for _ in range(60):
            if done():
                return True
            time.sleep(0.5)

    try:
        assert until(lambda: rows() == [(1, 1, 1), (2, 1, 1)])
        assert until(lambda: held() == [0])  # both keys were idle until their time was up
        put("b", [(1, 2)])
        assert until(lambda: rows() == [(1, 1, 1), (1, 2, 1), (2, 1, 1)])
    finally:
        q.stop()


def test_a_bad_page_does_not_fail_its_batch(spark, tmp_path):
    from folio.streaming import progress as PG

    @F.arrow_udf("long")
    def size(v: pa.Array) -> pa.Array:
        out = v.to_pylist()
        if any(x % 37 == 0 for x in out):
            raise ValueError("a bad page")
        return pa.array([x * 2 for x in out])

    spark.range(1, 120, 1, 3).withColumnRenamed("id", "image_id").write.parquet(str(tmp_path / "new"))
    src = spark.readStream.schema("image_id long").parquet(str(tmp_path / "new"))
    q = PG.incremental_ingest(src, lambda b: b.withColumn("size", size("image_id")), str(tmp_path / "out"), str(tmp_path / "cp"), key="image_id").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r.image_id: r for r in spark.read.option("mergeSchema", True).parquet(str(tmp_path / "out")).collect()}
    assert sorted(rows) == list(range(1, 120))
    assert {i for i, r in rows.items() if r.state == "Failed"} == {37, 74, 111} and all(r.error for r in rows.values() if r.state == "Failed")
    assert all(r.size == 2 * i for i, r in rows.items() if r.state == "Ready")
