"""Batch twins of the live operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.checks.base import query, view
from folio.checks.naming import full_pages, record
from folio.functions import pages as P
from folio.operators import ordered as O
from folio.plans import analyze as A
from folio.sources import tables as T
from folio.streaming import capture as CP
from folio.streaming import progress as PG

Q = F.col


def frames(spark, sf):
    """Camera frames with the signature of a tile; the tile count is a one-row aggregate."""
    n = T.read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    f = T.frames(spark, sf).withColumn("vec_id", Q("event_id") % n)
    return f.join(T.tile_signatures(spark, sf), "vec_id", "left").drop("vec_id")


@query("fil_09_capture_gates", "f4", """
    SELECT session_id, event_id, CASE WHEN NOT seen THEN 'Searching' WHEN confidence < 0.5 THEN 'Searching' END AS gate FROM f4""")
def _(spark, sf):
    return CP.with_gates(T.frames(spark, sf)).select("session_id", "event_id", "gate")


_U = [f"(x{i} / w * (0.25 + 0.15::DOUBLE * n) + d - 0.05)" for i in range(4)]
_V = [f"(y{i} / h * (0.25 + 0.15::DOUBLE * n) + d - 0.05)" for i in range(4)]
_TURN = " + ".join(f"({_U[i]} * {_V[(i + 1) % 4]} - {_U[(i + 1) % 4]} * {_V[i]})" for i in range(4))


@query("fil_09_all_gates", "f7", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN CAST(q AS INTEGER) % 9 = 0 THEN 'Searching'
      WHEN {' OR '.join(f"{c} <= 0.008 OR {c} >= 0.992" for c in _U + _V)} THEN 'OutOfFrame' WHEN abs({_TURN}) / 2 < 0.12 THEN 'TooFar' WHEN t * 10 < 0.5 THEN 'Searching' END AS gate FROM f7""")
def _(spark, sf):
    """Outlines of many sizes and places, so that every gate occurs."""
    d = T.quad_cases(spark, sf)
    size = F.lit(0.25) + 0.15 * Q("n")
    quad = F.array(*[Q("quad")[i] / Q("w" if i % 2 == 0 else "h") * size + Q("d") - 0.05 for i in range(8)])
    d = d.withColumn("quad", F.when(Q("q").cast("int") % 9 != 0, quad)).withColumn("confidence", Q("t") * 10)
    return CP.with_gates(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "gate")


@query("src_14_frame_source", "f4", "SELECT session_id, event_id, round(t, 6) AS t, seen, round(confidence, 6) AS confidence FROM f4")
def _(spark, sf):
    f = T.frames(spark, sf)
    return f.select("session_id", "event_id", F.round("t", 6).alias("t"), Q("quad").isNotNull().alias("seen"), F.round("confidence", 6).alias("confidence"))


# outlines of a session only shift by s along both axes; u is what the frame means to the session's state
view("cue_frame", """
    SELECT session_id, event_id, t, seen, s, row_number() OVER (PARTITION BY session_id ORDER BY t) AS k, NOT seen OR confidence < 0.5 AS barred,
           list_transform(embedding, lambda x: CAST(least(greatest(floor(128 + 200 * CAST(x AS DOUBLE)), 0), 255) AS BIGINT)) AS sig
    FROM f4 LEFT JOIN embeddings ON vec_id = event_id % (SELECT max(vec_id) + 1 FROM embeddings)""", ("f4",))
_EVENT = """
      SELECT f.*, p.mode, p.rs, p.rsig, p.since, p.gone, (f.t - p.since) / 0.9 AS share, CASE
        WHEN NOT f.seen THEN CASE WHEN p.mode = 'taken' AND f.t - p.gone >= 0.5 THEN 'away' ELSE 'empty' END
        WHEN p.mode = 'taken' AND sqrt(CAST(2 AS DOUBLE)) * abs(f.s - p.rs) <= 0.08
          AND coalesce(CAST(list_sum(list_transform(list_zip(f.sig, p.rsig), lambda z: abs(z[1] - z[2]))) AS DOUBLE) / len(f.sig), 0) <= 14 THEN 'same'
        WHEN f.barred THEN 'barred' WHEN p.mode = 'holding' AND sqrt(CAST(2 AS DOUBLE)) * abs(f.s - p.rs) <= 0.025 THEN CASE WHEN (f.t - p.since) / 0.9 >= 1 THEN 'ripe' ELSE 'still' END
        ELSE 'fresh' END AS u
      FROM cue_frame f JOIN PREVIOUS p ON p.session_id = f.session_id AND p.k + 1 = f.k"""
_AFTER = """
    SELECT session_id, event_id, k, u, CASE WHEN u IN ('fresh', 'still') THEN 'holding' WHEN u IN ('ripe', 'same') OR (u = 'empty' AND mode = 'taken') THEN 'taken' ELSE 'idle' END AS mode,
           CASE WHEN u IN ('fresh', 'ripe') THEN s ELSE rs END AS rs, CASE WHEN u IN ('fresh', 'ripe') THEN sig ELSE rsig END AS rsig, CASE WHEN u IN ('fresh', 'ripe') THEN t ELSE since END AS since,
           CASE WHEN NOT seen THEN coalesce(gone, t) END AS gone, CASE u WHEN 'ripe' THEN 1 WHEN 'still' THEN greatest(share, 0) ELSE 0 END AS progress, mode AS was FROM"""
view("cue_run", f"""
    SELECT session_id, NULL::BIGINT AS event_id, 0::BIGINT AS k, '' AS u, 'idle' AS mode, NULL::DOUBLE AS rs, NULL::BIGINT[] AS rsig, 0::DOUBLE AS since, NULL::DOUBLE AS gone, 0::DOUBLE AS progress, 'idle' AS was
    FROM (SELECT DISTINCT session_id FROM cue_frame) UNION ALL {_AFTER} ({_EVENT.replace('PREVIOUS', 'cue_run')})""", ("cue_frame",))


@query("str_01_capture_cues", "cue_run", """
    SELECT session_id, event_id, CASE u WHEN 'ripe' THEN 'Capture' WHEN 'same' THEN 'Captured' WHEN 'empty' THEN CASE WHEN was = 'taken' THEN 'Captured' ELSE 'Searching' END
      WHEN 'fresh' THEN 'Holding' WHEN 'still' THEN 'Holding' ELSE 'Searching' END AS cue, round(progress, 6) AS progress FROM cue_run WHERE k > 0""")
def _(spark, sf):
    return CP.capture_cues(frames(spark, sf)).select("session_id", "event_id", "cue", F.round("progress", 6).alias("progress"))


@query("str_02_next_stage", "f10_rules", """
    SELECT page_id, CASE WHEN state = 'Pending' THEN 'Thumb' WHEN state = 'Preview' THEN 'Proxy' WHEN state = 'Ready' AND (quad IS NULL OR (auto_quad AND detector_version < 2)) THEN 'Detect'
      WHEN state = 'Ready' AND quad IS NOT NULL AND needs_render THEN 'Prerender' END AS stage FROM f10_rules""")
def _(spark, sf):
    p = full_pages(spark, sf)
    p = p.withColumn("needs_render", P.needs_render(record(p)))
    due = P.needs_detection(Q("quad"), ~Q("auto_quad"), Q("detector_version"))
    return p.select("page_id", PG.next_stage(Q("state"), due, Q("quad").isNotNull(), Q("needs_render")).alias("stage"))


@query("str_02_page_progress")
def _(spark, sf):
    e = T.pages(spark, sf).select(Q("l_partkey").cast("string").alias("file_id"), "ts", "page_id", "state")
    e = O.numbered(e, "file_id", O.day("ts"), ["ts", "page_id", "state"], "seq").select(Q("file_id").alias("page_id"), "seq", "state")
    return PG.page_progress(e).select("page_id", "seq", "state", "before", "applied")


@query("str_03_import_progress", "f10", """
    SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE state <> 'Importing') AS done, count(*) FILTER (WHERE state = 'Failed') AS failures, round(max(floor(q / 50.0::DOUBLE / 0.04 + 1e-9) * 0.04::DOUBLE), 6) AS copied FROM f10 GROUP BY doc_id""")
def _(spark, sf):
    p = T.pages(spark, sf)
    share = p.groupBy("doc_id").agg(F.round(F.max(PG.copy_share(Q("q"), F.lit(50))), 6).alias("copied"))
    return PG.import_progress(p).join(share, "doc_id")


@query("str_04_debounce", "", """
    SELECT user_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS signals FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""")
def _(spark, sf):
    e = T.read(spark, sf, "events").select("user_id", Q("ts").cast("timestamp").alias("ts"))
    return PG.debounce(e, "user_id", "4 hours")


@query("str_06_frame_change", "f4 f2", """
    , n AS (SELECT max(image_id) + 1 AS n FROM f2), s AS (SELECT session_id, event_id, event_id % (SELECT n FROM n) AS a, lag(event_id) OVER (PARTITION BY session_id ORDER BY event_id) % (SELECT n FROM n) AS b FROM f4),
    d AS (SELECT p.a, p.b, sum(abs(x.v - y.v)) / 64.0 AS change FROM (SELECT DISTINCT a, b FROM s WHERE b IS NOT NULL) p JOIN f2 x ON x.image_id = p.a JOIN f2 y ON y.image_id = p.b AND y.y = x.y AND y.x = x.x GROUP BY p.a, p.b)
    SELECT session_id, event_id, round(change, 6) AS change FROM s LEFT JOIN d USING (a, b)""")
def _(spark, sf):
    return CP.frame_change(frames(spark, sf)).select("session_id", "event_id", F.round("change", 6).alias("change"))


@query("str_07_export_gates", "f5", """
    SELECT install, event_id, finished, CAST(greatest(0, 5 - count(*) FILTER (WHERE finished AND NOT is_pro) OVER w) AS INTEGER) AS remaining,
           finished AND NOT is_pro AND count(*) FILTER (WHERE finished) OVER w % 5 = 0 AS due FROM f5 WINDOW w AS (PARTITION BY install ORDER BY event_id)""")
def _(spark, sf):
    return PG.export_gates(T.export_events(spark, sf))


@query("str_08_stream_split", "f3", """
    SELECT batch_id, page_id, dense_rank() OVER (PARTITION BY batch_id ORDER BY g) AS doc_no, code AS doc_barcode FROM (
      SELECT *, max(CASE WHEN sep THEN barcode END) OVER (PARTITION BY batch_id, g) AS code FROM (
        SELECT *, count(*) FILTER (WHERE sep) OVER (PARTITION BY batch_id ORDER BY pos) AS g FROM (SELECT *, barcode IS NOT NULL AND starts_with(lower(barcode), 'sep-a') AS sep FROM f3))) WHERE NOT sep""")
def _(spark, sf):
    return PG.stream_split(T.batch_pages(spark, sf), "SEP-a")


@query("str_09_perf_windows", "f6_perf", """
    SELECT date_trunc('hour', ts) AS start_ts, name, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) AS runs FROM f6_perf GROUP BY 1, 2""")
def _(spark, sf):
    return PG.perf_windows(T.perf_rows(spark, sf))


@query("str_05_incremental_ingest", "ink_share", """
    SELECT image_id, CASE WHEN image_id % 23 = 5 AND h > 0 THEN 'Failed' ELSE 'Ready' END AS state, CASE WHEN image_id % 23 = 5 AND h > 0 THEN 'damaged' END AS error,
           CASE WHEN NOT (image_id % 23 = 5 AND h > 0) THEN round(ink_percent, 6) END AS ink_percent FROM ink_share JOIN f1_image USING (image_id)""")
def _(spark, sf):
    """The batch twin: pages with every 23rd cut short; those stay as failed rows."""
    pages = T.text_pages(spark, sf)
    pages = pages.withColumn("vals", F.when(Q("image_id") % 23 == 5, F.substring("vals", 1, 7)).otherwise(Q("vals")))
    fault = F.when(F.octet_length("vals") != Q("w") * Q("h"), "damaged")
    d = PG.ingested(pages, A.page_ink_percent, fault)
    return d.select("image_id", "state", "error", F.round("ink_percent", 6).alias("ink_percent"))
