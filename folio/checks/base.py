"""Query registry and the SQL views the checks share.

The SQL side rebuilds every input from the driver tables on its own, so a mistake in the
Spark views shows up as a mismatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# name -> (views it needs, definition)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f1_image": ((), """
        SELECT doc_id AS image_id, 64 AS w, CAST(ceil(length(text) / 64.0) AS INTEGER) AS h, text FROM documents"""),
    "f1": (("f1_image",), """
        SELECT image_id, w, h, CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x,
               CAST(CASE WHEN cp <= 32 THEN 255 WHEN cp < 97 THEN 20 + cp % 60 ELSE 215 + cp % 30 END AS INTEGER) AS v
        FROM (SELECT image_id, w, h, i, ascii(c) AS cp
              FROM (SELECT image_id, w, h, unnest(range(h * 64)) AS i, unnest(string_split(rpad(text, h * 64, ' '), '')) AS c FROM f1_image))"""),
    "f2": ((), """
        SELECT vec_id AS image_id, 8 AS w, 8 AS h, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
               CAST(least(greatest(floor(128 + 200 * CAST(embedding[i + 1] AS DOUBLE)), 0), 255) AS INTEGER) AS v
        FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)"""),
    "f2_rgb": (("f2",), """
        SELECT image_id // 3 AS image_id, 8 AS w, 8 AS h, y, x,
               coalesce(max(v) FILTER (WHERE image_id % 3 = 0), 255) AS r,
               coalesce(max(v) FILTER (WHERE image_id % 3 = 1), 255) AS g,
               coalesce(max(v) FILTER (WHERE image_id % 3 = 2), 255) AS b
        FROM f2 GROUP BY image_id // 3, y, x"""),
    "f2_mosaic": (("f2",), """
        SELECT i.image_id, 64 AS w, 64 AS h, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(v, 255) AS v
        FROM (SELECT DISTINCT image_id // 64 AS image_id FROM f2) i
        CROSS JOIN (SELECT unnest(range(64)) AS gy) CROSS JOIN (SELECT unnest(range(64)) AS gx)
        LEFT JOIN (SELECT image_id // 64 AS image_id, (image_id % 64) // 8 * 8 + y AS ty, image_id % 8 * 8 + x AS tx, v FROM f2) t
          ON t.image_id = i.image_id AND ty = gy AND tx = gx"""),
    "f3": ((), """
        SELECT conv_id AS batch_id, turn AS pos, conv_id || '-' || turn AS page_id, role AS kind,
               CASE WHEN length(text) % 5 = 0 THEN 'SEP-' || role || '-' || turn END AS barcode,
               length(text) % 7 = 0 AS is_blank, length(text) AS size
        FROM conversations"""),
    "f4": ((), """
        SELECT user_id AS session_id, event_id, ts, event_id / 1000.0::DOUBLE AS t, event_type <> 'error' AS seen,
               (CAST(floor(value) AS BIGINT) % 8) / 100.0::DOUBLE AS s,
               CAST(0.4 AS DOUBLE) + (event_id % 7) / CAST(10.0 AS DOUBLE) AS confidence
        FROM events"""),
    "f5": ((), """
        SELECT e.user_id AS install, e.ts, e.event_id, e.value < 100 AS finished, coalesce(e.ts >= p.pro_ts, false) AS is_pro
        FROM events e LEFT JOIN (SELECT user_id, min(ts) AS pro_ts FROM events
                                 WHERE event_type = 'signup' AND value > 60 GROUP BY user_id) p ON p.user_id = e.user_id
        WHERE e.event_type = 'purchase'"""),
    "f6_perf": ((), "SELECT ts, event_id, event_type AS name, CAST(floor(value) AS INTEGER) AS ms FROM events"),
    "f6_export": ((), """
        SELECT 'exports/' || source || '/doc-' || doc_id ||
               CASE n_chars % 4 WHEN 0 THEN '.pdf.partial' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS path,
               source, n_chars AS length, doc_id, 1704067200 + doc_id * 60 AS modified FROM documents"""),
    "f6_sig": ((), """
        SELECT p_partkey AS signature_id, CAST(CAST(floor(p_retailprice * 1000) AS BIGINT) % 16777216 AS INTEGER) AS color,
               40 + p_size * 4 AS mask_w, 20 + p_size AS mask_h FROM part"""),
    "f7_base": ((), """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount) AS d, abs(l_tax) AS t, l_quantity AS q,
               l_linenumber AS n, CAST(2592 + l_partkey % 50 * 8 AS INTEGER) AS w, CAST(4608 - l_partkey % 50 * 4 AS INTEGER) AS h,
               CAST(l_partkey % 10 AS INTEGER) AS exif, CAST(90 * (l_linenumber - 4) AS INTEGER) AS deg FROM lineitem"""),
    "f7": (("f7_base",), """
        SELECT *, x0 + q * 4 AS u0, y0 - q * 4 / 2 AS v0, x1 + q * 4 AS u1, y1 - q * 4 / 2 AS v1,
               x2 + q * 4 AS u2, y2 - q * 4 / 2 AS v2, x3 + q * 4 AS u3, y3 - q * 4 / 2 AS v3
        FROM (SELECT *, w * (CAST(0.1 AS DOUBLE) + d) AS x0, h * (CAST(0.1 AS DOUBLE) + t) AS y0,
                     w * (CAST(0.9 AS DOUBLE) - t) AS x1, h * (CAST(0.1 AS DOUBLE) + q / 1000) AS y1,
                     w * (CAST(0.9 AS DOUBLE) - q / 1000) AS x2, h * (CAST(0.9 AS DOUBLE) - d) AS y2,
                     w * (CAST(0.1 AS DOUBLE) + t / 2) AS x3, h * (CAST(0.9 AS DOUBLE) + (n - 4) / CAST(50.0 AS DOUBLE)) AS y3
              FROM f7_base)"""),
    "f7_line": ((), """
        SELECT l_orderkey AS image_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_id,
               CAST(l_partkey % 180 AS DOUBLE) AS theta, CAST(l_suppkey % 97 * 4 + l_linenumber * 10 AS DOUBLE) AS rho,
               l_quantity AS votes, l_returnflag = 'A' AS is_border, abs(l_tax) * 100 + l_quantity AS strength FROM lineitem"""),
    "f8": ((), """
        SELECT doc_id, text AS name, 1704067200 + doc_id * 60 AS created,
               CASE WHEN doc_id % 31 = 0 THEN 'src999' WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS folder_id, n_chars
        FROM documents"""),
    "f8_folder": ((), """
        SELECT DISTINCT source AS folder_id, 'Thư mục ' || upper(source) AS folder_name FROM documents"""),
    "f9": ((), """
        SELECT page_id, line, k, text, k * 100 AS x, line * 30 AS y, length(text) * 12 AS w,
               CASE WHEN length(text) > 0 THEN 24 ELSE 0 END AS h, line * 30 + 20 AS baseline_y, 50 + length(text) % 50 AS confidence
        FROM (SELECT page_id, line, unnest(ws) AS text, unnest(range(len(ws))) AS k
              FROM (SELECT page_id, line, string_split(t, ' ') AS ws
                    FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS t,
                                 unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)))"""),
    "f10": ((), """
        SELECT *, CASE WHEN q % 7 = 0 THEN 'Color' ELSE mode END AS r_mode, CASE WHEN q % 11 = 0 THEN 50 ELSE darkness END AS r_darkness,
               CASE WHEN q % 13 = 0 THEN 0 ELSE brightness END AS r_brightness, CASE WHEN q % 17 = 0 THEN 0 ELSE contrast END AS r_contrast,
               CASE WHEN q % 19 = 0 THEN 0 ELSE rotation END AS r_rotation
        FROM (SELECT l_orderkey AS doc_id, l_linenumber AS pos,
                     l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS page_id,
                     CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Failed' WHEN l_returnflag = 'R' THEN 'Pending'
                          WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Preview'
                          WHEN CAST(l_quantity AS INTEGER) % 10 = 0 THEN 'Importing' ELSE 'Ready' END AS state,
                     CASE l_linenumber % 3 WHEN 0 THEN 'Color' WHEN 1 THEN 'Gray' ELSE 'BlackWhite' END AS mode,
                     CAST(l_quantity AS INTEGER) * 2 AS darkness,
                     CAST(round_even(abs(l_tax) * 100, 0) AS INTEGER) * 10 - 40 AS brightness,
                     CAST(round_even(abs(l_discount) * 100, 0) AS INTEGER) * 10 - 50 AS contrast,
                     CAST(90 * (l_partkey % 4) AS INTEGER) AS rotation,
                     l_suppkey % 3 <> 0 AS has_quad, l_suppkey % 5 <> 0 AS auto_quad, CAST(l_suppkey % 4 AS INTEGER) AS detector_version,
                     CAST(l_partkey % 3 AS INTEGER) AS render_version, l_partkey % 13 <> 0 AS has_render,
                     'pages/' || l_suppkey || '/' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '.JPG' ELSE '.png' END AS path,
                     l_shipdate AS ts, CAST(l_quantity AS INTEGER) AS q,
                     CAST(round_even(abs(l_discount) * 100, 0) AS INTEGER) AS d100,
                     CAST(round_even(abs(l_tax) * 100, 0) AS INTEGER) AS t100, l_partkey, l_suppkey
              FROM lineitem)"""),
}


def view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (needs, sql)


def with_views(needs: str, body: str) -> str:
    """``body`` preceded by the named views and everything they build on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its check (none where SQL cannot express the operator)."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(needs, sql)
        return fn

    return register
