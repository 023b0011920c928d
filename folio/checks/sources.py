"""File-shaped inputs derived from the driver tables; real files are covered by the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.checks.base import query, view
from folio.checks.geometry import PAPER
from folio.functions import pages as P
from folio.sources import files as FS
from folio.session import checkpoint_dir
from folio.sources import tables as T

Q = F.col


@query("src_01_page_files", "f6_export f10", """
    SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.pdf', '.jpg', '.png') AS ok, CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.jpg', '.png') THEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) ELSE '.jpg' END AS photo
    FROM (SELECT path FROM f6_export UNION ALL SELECT path FROM f10)""")
def _(spark, sf):
    p = T.export_files(spark, sf).select("path").unionByName(T.pages(spark, sf).select("path"))
    return p.select("path", FS.supported(Q("path")).alias("ok"), FS.photo_extension(Q("path")).alias("photo"))


def picture_files(spark, sf):
    """A picture file per row of ``part``: six kinds of headers, long segments before the density, and files cut off."""
    i, z = Q("p_partkey"), Q("p_size")
    w, h, d = 600 + z * 37, 800 + i * 13 % 2000, 100 + z * 7 % 500
    be = lambda c, n: F.lpad(F.hex(F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")), 2 * n, "0")
    le = lambda c, n: F.concat(*[F.substring(be(c, n), 2 * k + 1, 2) for k in reversed(range(n))])
    bytes_of = lambda *parts: F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    fill = "00" * 6000
    per_m = F.rint(d / 0.0254)
    start = ("89504E470D0A1A0A", "0000000D49484452", be(w, 4), be(h, 4), "0800000000", "00000000")
    png = bytes_of(*start, be(6000, 4), "74455874", fill, "00000000", "0000000970485973", be(per_m, 4), be(per_m, 4), "01", "00000000", "0000000049444154", "00000000")
    jpeg = lambda unit, x: bytes_of("FFD8FFE000104A46494600", "0102", be(unit, 1), be(x, 2), be(x, 2), "0000", "FFE1", be(6002, 2), fill, "FFFFC2", "0011", "08", be(h, 2), be(w, 2), "03", "00" * 9)
    bmp = bytes_of("424D", "00" * 8, le(54, 4), le(40, 4), le(w, 4), le(h, 4), "01001800", "00" * 8, le(per_m, 4), le(per_m, 4), "00" * 8)
    gif = bytes_of("474946383961", le(w, 2), le(h, 2), "000000")
    entry = lambda tag, kind, value: (be(tag, 2), be(kind, 2), "00000001", value)
    tiff = bytes_of("4D4D002A", be(6024, 4), be(d, 4), "00000001", be(d * 10, 4), "0000000A", fill, "0005", *entry(256, 4, be(w, 4)), *entry(257, 4, be(h, 4)), *entry(282, 5, be(8, 4)),
                    *entry(283, 5, be(16, 4)), *entry(296, 3, "00020000"), "00000000")
    kinds = (png, jpeg(1, d), jpeg(2, 40 + z), bmp, gif, tiff)
    body = F.substring(png, 1, 20)
    for k, c in enumerate(kinds):
        body = F.when(i % 7 == k, c).otherwise(body)
    return T.read(spark, sf, "part").select(i.cast("string").alias("path"), body.alias("content"))


@query("src_03_image_info", "", f"""
    WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, CAST(600 + p_size * 37 AS INTEGER) AS w, CAST(800 + p_partkey * 13 % 2000 AS INTEGER) AS h, 100 + p_size * 7 % 500 AS d, 40 + p_size AS cm FROM part),
    est AS (SELECT p_partkey, arg_min(wi, (abs(wi / hi - w / CAST(h AS DOUBLE)), o)) AS wi FROM p CROSS JOIN {PAPER} WHERE k = 4 GROUP BY p_partkey),
    r AS (SELECT p.*, CASE k WHEN 2 THEN round_even(cm * CAST(2.54 AS DOUBLE), 0) WHEN 4 THEN round_even(w / wi, 0) ELSE d END AS dpi FROM p LEFT JOIN est USING (p_partkey))
    SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN k < 6 THEN w END AS w, CASE WHEN k < 6 THEN h END AS h, CASE WHEN k < 6 THEN CAST(dpi AS INTEGER) END AS dpi_x, CASE WHEN k < 6 THEN CAST(dpi AS INTEGER) END AS dpi_y,
           CASE WHEN k < 6 THEN 'Ready' ELSE 'Failed' END AS state FROM r""")
def _(spark, sf):
    return FS.image_info(picture_files(spark, sf))


@query("src_04_fan_out_frames", "", """
    SELECT p_partkey, CAST(k AS INTEGER) AS k, CASE WHEN pdf OR n > 1 THEN p_name || ' #' || k ELSE p_name END AS label
    FROM (SELECT p_partkey, p_name, 1 + p_size % 7 AS n, p_partkey % 3 = 0 AS pdf, unnest(range(1, 2 + p_size % 7)) AS k FROM part)""")
def _(spark, sf):
    f = T.read(spark, sf, "part").select("p_partkey", Q("p_name").alias("name"), (1 + Q("p_size") % 7).alias("frames"), (Q("p_partkey") % 3 == 0).alias("is_pdf"))
    return FS.fan_out_frames(f).select("p_partkey", "k", "label")


@query("src_10_normalize_settings", "", """
    SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(CAST(l_partkey % 500 AS INTEGER), 60), 300) AS thumbnail_size, least(greatest(CAST(l_suppkey * 9 - 50 AS INTEGER), 1), 500) AS max_undo,
           least(greatest(CAST(l_quantity * 3 - 20 AS INTEGER), 1), 100) AS jpeg_quality, round(least(greatest(abs(l_tax) * 20, 0.05), 1), 6) AS sauvola_k, round(least(greatest(l_quantity / 5 - 3, 0), 5), 6) AS blank_percent,
           CASE WHEN l_linenumber % 2 = 0 THEN 'vie+eng' ELSE l_returnflag END AS ocr_languages FROM lineitem""")
def _(spark, sf):
    li = T.read(spark, sf, "lineitem")
    s = P.normalize_settings({
        "thumbnail_size": (Q("l_partkey") % 500).cast("int"), "max_undo": (Q("l_suppkey") * 9 - 50).cast("int"), "jpeg_quality": (Q("l_quantity") * 3 - 20).cast("int"),
        "sauvola_k": F.abs("l_tax") * 20, "blank_percent": Q("l_quantity") / 5 - 3, "ocr_languages": F.when(Q("l_linenumber") % 2 == 0, "  ").otherwise(Q("l_returnflag"))})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 6) if k in ("sauvola_k", "blank_percent") else c).alias(k) for k, c in s.items()])


@query("src_11_perf_log", "f6_perf", "SELECT event_id, name || ' x' AS name, ms FROM f6_perf WHERE event_id % 3 <> 2")
def _(spark, sf):
    p = T.perf_rows(spark, sf)
    line = F.when(Q("event_id") % 3 == 0, F.concat(F.lit("2024-01-01 INFO PERF "), "name", F.lit(" x "), Q("ms").cast("string"), F.lit(" ms"))).when(
        Q("event_id") % 3 == 1, F.concat("name", F.lit(" x "), Q("ms").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.lit("started "), "name"))
    return FS.parse_perf(p.select("event_id", line.alias("value"))).select("event_id", "name", "ms")


@query("src_13_list_exports", "f6_export", """
    SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS name, length FROM f6_export WHERE lower(path) LIKE '%.pdf'""")
def _(spark, sf):
    return FS.list_exports(T.export_files(spark, sf)).select("path", "name", "length")


def scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/folio-checks/{name}-{uuid.uuid4().hex}"


@query("src_07_project", "f10", """
    SELECT page_id, path, CASE WHEN state IN ('Ready', 'Failed') THEN state WHEN state = 'Pending' THEN 'Failed' ELSE 'Ready' END AS state,
           CASE WHEN state = 'Pending' THEN 'interrupted' END AS error, rotation AS rotate, CAST(-1 AS INTEGER) AS pdf_page FROM f10""")
def _(spark, sf):
    p = T.pages(spark, sf).select(Q("page_id").alias("_Id"), Q("path").alias("_File"), Q("state").alias("_State"), Q("rotation").alias("_Rotate"))
    at = scratch(spark, "project")
    p.write.format("xml").option("rootTag", "ScanProject").option("rowTag", "Page").save(at)
    return FS.read_project(spark, at).select("page_id", "path", "state", "error", "rotate", "pdf_page")


@query("src_12_versioned_save", "f8", "SELECT doc_id, folder_id, n_chars FROM f8 WHERE n_chars % 2 = 0")
def _(spark, sf):
    """Three saves, the last cut off before its marker: the second is what a reader sees."""
    d, at = T.documents(spark, sf).select("doc_id", "folder_id", "n_chars"), scratch(spark, "catalogue")
    FS.write_catalogue(d, at, 1)
    FS.write_catalogue(d.filter("n_chars % 2 = 0"), at, 2)
    d.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{at}/v={3:012d}")
    return FS.read_latest_version(spark, at)


@query("src_15_page_store", "f2", """
    SELECT image_id // 16 AS doc_id, image_id, CAST(CASE WHEN image_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS revision, y,
           CAST(sum(CASE WHEN image_id % 3 = 0 THEN 255 - v ELSE v END) AS BIGINT) AS total FROM f2 GROUP BY image_id, y""")
def _(spark, sf):
    rows = T.tile_pixels(spark, sf).groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("vals"))
    rows = rows.withColumns({"doc_id": F.floor(Q("image_id") / 16), "revision": F.lit(1)})
    at = scratch(spark, "pages")
    FS.write_pages(rows, at, 8)
    FS.write_pages(rows.filter("image_id % 3 = 0").withColumns({"vals": F.transform("vals", lambda v: 255 - v), "revision": F.lit(2)}), at, 8)
    total = F.aggregate("vals", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return FS.read_pages(spark, at).select("doc_id", "image_id", "revision", "y", total.alias("total"))


# --- files of JSON, from table rows as (file, value) -------------------------------

view("c5", """
    SELECT doc_id, source, n_chars, doc_id % 13 = 0 AS broken, doc_id % 17 = 0 AS elsewhere FROM documents""")


def document_files(spark, sf):
    """A document file per row of ``documents`` with two pages, the second one bare; some are cut off, some lie in another folder."""
    d = T.read(spark, sf, "documents")
    i, n = Q("doc_id"), Q("n_chars")
    fields = {"id": F.concat(F.lit("p"), i), "state": F.when(i % 3 == 0, "Failed"), "rawWidth": (n % 3000).cast("int"), "userRotation": (i % 4 * 90).cast("int"), "cropManual": F.when(i % 5 == 0, True),
              "cropQuad": F.when(i % 2 == 0, F.array(*[F.lit(x / 8) for x in range(8)])), "colorMode": F.when(i % 7 == 0, "Gray"), "croppedContrast": F.when(i % 11 == 0, 20), "originalExtension": F.when(i % 6 == 0, ".png")}
    full = F.struct(*[c.alias(k) for k, c in fields.items()])
    bare = F.struct(*[(F.concat(F.lit("q"), i) if k == "id" else F.lit(None).cast(FS.PAGE[k].dataType)).alias(k) for k in fields])
    name = F.concat(F.lit("d"), i)
    body = F.to_json(F.struct(name.alias("id"), Q("source").alias("name"), F.array(full, bare).alias("pages")))
    return d.select(F.concat(F.lit("store/"), F.when(i % 17 == 0, "other").otherwise(name), F.lit("/doc.json")).alias("file"),
                    F.when(i % 13 == 0, F.substring(body, 1, 40)).otherwise(body).alias("value"))


@query("src_05_catalogue", "c5", """
    SELECT 'd' || doc_id AS doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = 0 THEN 'p' ELSE 'q' END || doc_id AS id, CASE WHEN pos = 0 AND doc_id % 3 = 0 THEN 'Failed' ELSE 'Ready' END AS state,
           CAST(CASE WHEN pos = 0 THEN n_chars % 3000 ELSE 0 END AS INTEGER) AS "rawWidth", CAST(CASE WHEN pos = 0 THEN doc_id % 4 * 90 ELSE 0 END AS INTEGER) AS "userRotation", pos = 0 AND doc_id % 5 = 0 AS "cropManual",
           CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN 8 ELSE NULL END AS corners, CASE WHEN pos = 0 AND doc_id % 7 = 0 THEN 'Gray' ELSE 'Color' END AS "colorMode",
           CASE WHEN pos = 0 AND doc_id % 11 = 0 THEN 20 ELSE 0 END AS "croppedContrast", CASE WHEN pos = 0 AND doc_id % 6 = 0 THEN '.png' ELSE '.jpg' END AS "originalExtension",
           50 AS "bwDarkness", true AS "cleanBackground", 1 AS "exifOrientation", 40 AS fields
    FROM c5 CROSS JOIN (VALUES (0), (1)) v(pos) WHERE NOT broken AND NOT elsewhere""")
def _(spark, sf):
    p = FS.catalogue_pages(FS.parse_catalogue(document_files(spark, sf)))
    return p.select("doc_id", "pos", "id", "state", "rawWidth", "userRotation", "cropManual", F.when(Q("cropQuad").isNotNull(), F.size("cropQuad")).alias("corners"), "colorMode", "croppedContrast", "originalExtension",
                    "bwDarkness", "cleanBackground", "exifOrientation", F.lit(len(p.columns) - 2).alias("fields"))


def lists(d, key, fields, broken):
    """``file, value``: a file for each ``key`` with a list of its rows; files with ``broken`` are cut off."""
    body = F.to_json(F.collect_list(F.struct(*[c.alias(k) for k, c in fields.items()])))
    g = d.groupBy(key.alias("k")).agg(body.alias("body"))
    return g.select(F.concat(F.lit("cache/"), Q("k"), F.lit(".json")).alias("file"), F.when(broken(Q("k")), F.concat(F.lit("{"), F.substring("body", 1, 20))).otherwise(Q("body")).alias("value"))


@query("src_06_folders", "", "SELECT 'f' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 50 <> 7 AND c_custkey % 9 <> 0")
def _(spark, sf):
    c = T.read(spark, sf, "customer")
    i = Q("c_custkey")
    files = lists(c, (i % 50).cast("string"), {"id": F.when(i % 9 != 0, F.concat(F.lit("f"), i)), "name": Q("c_name")}, lambda k: k == "7")
    return FS.parse_folders(files).select("id", "name")


@query("src_08_ocr_words", "f9", """
    SELECT CAST(page_id AS VARCHAR) AS key, text, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(baseline_y AS INTEGER) AS baseline_y, CAST(confidence AS DOUBLE) AS confidence
    FROM f9 WHERE page_id % 19 <> 3""")
def _(spark, sf):
    o = T.words(spark, sf, dealt=True)
    fields = {"Text": Q("text"), **{k: Q(c).cast("int") for k, c in (("X", "x"), ("Y", "y"), ("Width", "w"), ("Height", "h"), ("BaselineY", "baseline_y"))}, "Confidence": Q("confidence").cast("float")}
    words = FS.parse_ocr_words(lists(o, Q("page_id"), fields, lambda k: k % 19 == 3))
    return words.withColumn("confidence", Q("confidence").cast("double"))


@query("src_09_signatures", "f6_sig", """
    SELECT 's' || signature_id AS id, CAST(color AS BIGINT) AS color, CAST(mask_w AS INTEGER) AS width, CAST(mask_h AS INTEGER) AS height FROM f6_sig WHERE signature_id % 40 <> 11""")
def _(spark, sf):
    g = T.signatures(spark, sf)
    i = Q("signature_id")
    files = lists(g, (i % 40).cast("string"), {"id": F.concat(F.lit("s"), i), "color": Q("color"), "width": Q("mask_w"), "height": Q("mask_h")}, lambda k: k == "11")
    return FS.parse_signatures(files).select("id", "color", "width", "height")
