"""Names, keys, search, and small page rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.checks.base import query, view
from folio.functions import layout as L
from folio.functions import naming as N
from folio.functions import pages as P
from folio.sources import tables as T

Q = F.col

view("f10_look", """
    SELECT *, d100 % 2 = 0 AS clean, (d100 + t100) % 2 = 0 AS r_clean FROM f10""", ("f10",))
SAME = """(mode = r_mode AND (mode <> 'BlackWhite' OR darkness = r_darkness) AND (mode = 'Color' OR clean = r_clean)
    AND brightness = r_brightness AND (mode = 'BlackWhite' OR contrast = r_contrast))"""


def looks(spark, sf):
    p = T.pages(spark, sf).withColumns({"clean": Q("d100") % 2 == 0, "r_clean": (Q("d100") + Q("t100")) % 2 == 0})
    look = lambda r: F.struct(*[Q(f"{r}{c}").alias(c) for c in ("mode", "darkness", "clean", "brightness", "contrast")])
    return p.withColumns({"look": look(""), "r_look": look("r_")})


@query("sca_30_same_look", "f10_look", f"SELECT page_id, {SAME} AS same FROM f10_look")
def _(spark, sf):
    return looks(spark, sf).select("page_id", P.same_look(Q("look"), Q("r_look")).alias("same"))


@query("sca_31_ops", "f10", r"""
    SELECT page_id, rotation % 360 = 0 AND d100 = 0 AND t100 = 0 AS identity, (rotation + 630) % 360 AS turned,
      'r' || (rotation % 360) || '|d' || regexp_replace(printf('%.3f', CAST(d100 AS DOUBLE) / 4), '\.?0+$', '') || '|c' || crop AS signature,
      page_id || '|' || path || '|-1|r' || (rotation % 360) AS view_key, CASE WHEN crop <> '' THEN round(CAST(string_split(crop, ',')[3] AS DOUBLE), 5) END AS crop_w
    FROM (SELECT *, CASE WHEN t100 = 0 THEN '' ELSE regexp_replace(printf('%.5f', t100 / 100.0::DOUBLE), '\.?0+$', '') || ',' || regexp_replace(printf('%.5f', d100 / 80.0::DOUBLE), '\.?0+$', '') || ',0.5,0.25' END AS crop FROM f10)""")
def _(spark, sf):
    p = T.pages(spark, sf)
    crop = F.when(Q("t100") != 0, F.array(Q("t100") / 100.0, Q("d100") / 80.0, F.lit(0.5), F.lit(0.25)))
    p = p.withColumn("crop", crop).withColumn("deskew", Q("d100").cast("double") / 4)
    sig = N.ops_signature(Q("rotation"), Q("deskew"), Q("crop"))
    return p.select("page_id", N.ops_is_identity(Q("rotation"), Q("deskew"), Q("crop")).alias("identity"),
                    N.rotated_by(Q("rotation"), F.lit(-90)).alias("turned"), sig.alias("signature"),
                    F.concat_ws("|", "page_id", "path", F.lit("-1"), F.concat(F.lit("r"), (Q("rotation") % 360).cast("string"))).alias("view_key"),
                    F.round(N.parse_crop(N.format_crop(Q("crop")))[2], 5).alias("crop_w"))


@query("sca_32_cache_key", "f10", """
    SELECT page_id, substr(sha1(lower(path) || '|-1|' || q || '|' || d100 || '|r' || rotation || '|300|Auto'), 1, 24) AS ocr_key,
           substr(sha1(lower(path) || '|-1|' || q || '|' || d100 || '|'), 1, 20) AS proxy_key FROM f10""")
def _(spark, sf):
    stamp = N.source_stamp(Q("path"), F.lit(-1), Q("q"), Q("d100"))
    return T.pages(spark, sf).select(
        "page_id", N.cache_key([stamp, F.concat(F.lit("r"), Q("rotation").cast("string")), F.lit(300), F.lit("Auto")]).alias("ocr_key"),
        N.cache_key([stamp, F.lit("")], 20).alias("proxy_key"))


@query("sca_33_build_name", "f3", """
    SELECT page_id, 'HD_2026-09-25_' || lpad(CAST(pos AS VARCHAR), CAST(greatest(3, length(CAST(pos AS VARCHAR))) AS INTEGER), '0') || '_' || coalesce(replace(barcode, '/', '_'), '') || '_{other}' AS name,
           '20260925-060000-' || lpad(CAST(pos AS VARCHAR), 5, '0') || '-' || kind AS name2 FROM f3""")
def _(spark, sf):
    ts = F.timestamp_seconds(F.lit(1790316000))
    p = T.batch_pages(spark, sf)
    return p.select("page_id", N.build_name("HD_{yyyy}-{MM}-{dd}_{counter}_{barcode}_{other}", ts, Q("pos"), Q("barcode")).alias("name"),
                    N.build_name("{date}-{time}-{counter:00000}-{profile}", ts, Q("pos"), None, Q("kind")).alias("name2"))


@query("sca_34_sanitize_name", "f8", r"""
    SELECT doc_id, CASE WHEN s = '' THEN 'Scan' ELSE s END AS safe FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(name, '[\x00-\x1f"<>|:*?\\/]', '_', 'g'), '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g'), '\.+$', '') AS s FROM f8)""")
def _(spark, sf):
    return T.documents(spark, sf).select("doc_id", N.sanitize_name(Q("name")).alias("safe"))


@query("sca_35_document_file_name", "f8", r"""
    SELECT doc_id, CASE WHEN s = '' THEN 'Tai lieu' ELSE s END || '.pdf' AS file FROM (
      SELECT doc_id, CASE WHEN length(s) > 80 THEN regexp_replace(substr(s, 1, 80), '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g') ELSE s END AS s FROM (
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(name, '[\x00-\x1f\x{7f}-\x{9f}"<>|:*?\\/]', '-', 'g'), '^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g'), '^\.+|\.+$', '', 'g') AS s FROM f8))""")
def _(spark, sf):
    return T.documents(spark, sf).select("doc_id", N.document_file_name(Q("name")).alias("file"))


@query("sca_37_quality_for", "f8", """
    SELECT doc_id, coalesce(k, 'medium') AS key, coalesce(dpi, 200) AS dpi, coalesce(jq, 72) AS jpeg_quality, CASE WHEN k IS NULL THEN 150 ELSE gd END AS gray_dpi,
           CAST(round_even(11.69 * coalesce(dpi, 200), 0) AS INTEGER) AS long_edge, CAST(round_even(11.69 * CASE WHEN k IS NULL THEN 150 ELSE gd END, 0) AS INTEGER) AS gray_long_edge
    FROM f8 LEFT JOIN (VALUES ('small', 150, 60, NULL), ('high', 300, 90, 300)) v(k, dpi, jq, gd) ON k = CASE n_chars % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'high' WHEN 2 THEN 'best' END""")
def _(spark, sf):
    d = T.documents(spark, sf)
    key = F.when(Q("n_chars") % 4 == 0, "small").when(Q("n_chars") % 4 == 1, "high").when(Q("n_chars") % 4 == 2, "best")
    return d.select("doc_id", L.quality_for(key).alias("p")).select("doc_id", "p.*")


@query("sca_38_export_codec", "f10", """
    SELECT page_id, kind, CASE WHEN kind = 'Bitonal' THEN 'bitonal' WHEN raw AND q % 2 = 0 THEN 'original' WHEN kind = 'Gray' THEN 'gray-jpeg' ELSE 'color-jpeg' END AS codec
    FROM (SELECT *, path LIKE '%.JPG' AND rotation = 0 AND d100 = 0 AS raw, CASE q % 4 WHEN 0 THEN 'Bitonal' WHEN 1 THEN 'Gray' WHEN 2 THEN 'Color'
            ELSE CASE mode WHEN 'BlackWhite' THEN 'Bitonal' ELSE mode END END AS kind FROM f10)""")
def _(spark, sf):
    p = T.pages(spark, sf)
    mode = F.element_at(F.array(F.lit("BlackAndWhite"), F.lit("Gray"), F.lit("Color"), F.lit("Auto")), Q("q") % 4 + 1)
    kind = P.decide_kind(mode, F.when(Q("mode") == "BlackWhite", "Bitonal").otherwise(Q("mode")))
    raw = P.is_raw_jpeg(F.lit(False), N.ops_is_identity(Q("rotation"), Q("d100"), F.lit(None).cast("array<double>")), N.extension(Q("path")))
    return p.select("page_id", kind.alias("kind"), raw.alias("raw"), "q").select("page_id", "kind", P.export_codec(Q("kind"), Q("raw"), Q("q") % 2 == 0).alias("codec"))


@query("sca_39_text_layer", "f9", """
    SELECT page_id, line, k, round(x * 72.0::DOUBLE / 200, 6) AS tx, round(841.89::DOUBLE - baseline_y * 72.0::DOUBLE / 200, 6) AS ty,
           round(greatest(1, h * 72.0::DOUBLE / 200), 6) AS size, round(100.0::DOUBLE * (w * 72.0::DOUBLE / 200) / (length(text) * greatest(1, h * 72.0::DOUBLE / 200) * 0.5::DOUBLE), 6) AS scale,
           length(text) * 4 + 4 AS hex_len FROM f9 WHERE w > 0 AND h > 0 AND length(text) > 0""")
def _(spark, sf):
    from folio.operators.words import text_layer
    d = text_layer(T.words(spark, sf), 200, 841.89)
    return d.select("page_id", "line", "k", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "size", "scale")], F.length("hex").alias("hex_len"))


@query("sca_40_fold", "f8", "SELECT doc_id, replace(lower(strip_accents(name)), 'đ', 'd') AS folded FROM f8")
def _(spark, sf):
    return T.documents(spark, sf).select("doc_id", N.fold(Q("name")).alias("folded"))


@query("sca_42_valid_id", "f9", "SELECT page_id, line, k, regexp_full_match(text, '[A-Za-z0-9]+') AS ok FROM f9")
def _(spark, sf):
    return T.words(spark, sf).select("page_id", "line", "k", N.valid_id(Q("text")).alias("ok"))


@query("sca_48_ocr_text_clean", "f9", """
    SELECT page_id, line, k, nfc_normalize(text || chr(769)) AS text FROM f9""")
def _(spark, sf):
    w = T.words(spark, sf)
    spaced = F.concat(F.lit("  "), "text", F.lit("́ "))
    # the words leave a generator: the filter on them can't be pushed below it, where it would compose them once more
    return w.select("page_id", "line", "k", F.explode(F.array(N.ocr_text_clean(spaced))).alias("text")).filter("text IS NOT NULL")


@query("sca_50_trial_state", "f5", """
    SELECT install, event_id, greatest(0, 5 - greatest(0, used)) AS remaining, is_pro OR greatest(0, 5 - greatest(0, used)) > 0 AS can_export
    FROM (SELECT *, CAST(event_id % 9 - 2 AS INTEGER) AS used FROM f5)""")
def _(spark, sf):
    e = T.export_events(spark, sf).withColumn("used", (Q("event_id") % 9 - 2).cast("int"))
    return e.select("install", "event_id", P.exports_remaining(Q("used")).alias("remaining"), P.can_export(Q("is_pro"), Q("used")).alias("can_export"))


# --- predicates --------------------------------------------------------------------

view("f10_full", """
    SELECT *, CASE WHEN has_render THEN 1 + q ELSE 0 END AS revision, render_version + 3 AS geometry, q % 3 AS bw_version,
           CASE WHEN has_quad THEN d100 ELSE NULL END AS quad, CASE WHEN q % 29 = 0 THEN NULL WHEN q % 23 = 0 THEN d100 + 1 ELSE CASE WHEN has_quad THEN d100 END END AS r_quad,
           CASE WHEN q % 5 = 0 THEN NULL ELSE t100 END AS bend, CASE WHEN q % 31 = 0 THEN t100 + 1 WHEN q % 10 = 0 THEN 0 ELSE CASE WHEN q % 5 = 0 THEN NULL ELSE t100 END END AS r_bend,
           CASE WHEN q % 4 = 0 THEN 0 ELSE t100 % 3 END AS stamps, CASE WHEN q % 37 = 0 THEN 2 WHEN q % 4 = 0 THEN 0 ELSE t100 % 3 END AS r_stamps,
           d100 % 4 * 90 AS turn, CASE WHEN q % 41 = 0 THEN 0 ELSE d100 % 4 * 90 END AS r_turn, t100 % 2 = 0 AS free, CASE WHEN q % 43 = 0 THEN false ELSE t100 % 2 = 0 END AS r_free FROM f10_look""", ("f10_look",))
view("f10_rules", f"""
    SELECT *, revision = 0 OR r_rotation <> rotation OR r_turn <> turn OR r_free <> free OR outdated OR (quad IS NOT NULL AND quad IS DISTINCT FROM r_quad)
              OR coalesce(bend, 0) <> coalesce(r_bend, 0) OR stamps <> r_stamps OR NOT {SAME} AS needs_render
    FROM (SELECT *, revision > 0 AND (geometry < 5 OR (r_mode = 'BlackWhite' AND bw_version < 2)) AS outdated FROM f10_full)""", ("f10_full",))


def full_pages(spark, sf):
    """Page records with outline, bends, stamps and the twins their render was made with."""
    p = looks(spark, sf)
    q = Q("q")
    arr = lambda c: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda _: c.cast("double"))
    quad = F.when(Q("has_quad"), arr(Q("d100")))
    bend = F.when(q % 5 != 0, arr(Q("t100")))
    ids = lambda n: F.slice(F.array(F.lit("sig1"), F.lit("sig2")), F.lit(1), n)
    stamps = F.when(q % 4 != 0, ids(Q("t100") % 3))
    return p.withColumns({
        "revision": F.when(Q("has_render"), 1 + q).otherwise(0), "geometry": Q("render_version") + 3, "bw_version": q % 3,
        "quad": quad, "r_quad": F.when(q % 29 == 0, F.lit(None)).when(q % 23 == 0, arr(Q("d100") + 1)).otherwise(quad),
        "bend": bend, "r_bend": F.when(q % 31 == 0, arr(Q("t100") + 1)).when(q % 10 == 0, arr(F.lit(0))).otherwise(bend),
        "stamps": stamps, "r_stamps": F.when(q % 37 == 0, ids(F.lit(2))).otherwise(stamps),
        "turn": Q("d100") % 4 * 90, "r_turn": F.when(q % 41 == 0, 0).otherwise(Q("d100") % 4 * 90),
        "free": Q("t100") % 2 == 0, "r_free": F.when(q % 43 == 0, False).otherwise(Q("t100") % 2 == 0)})


def record(df):
    return {c: F.col(c) for c in df.columns}


@query("fil_01_exportable", "f10_rules", """
    SELECT doc_id, count(*) FILTER (WHERE ok) AS ready, count(*) FILTER (WHERE state = 'Ready') AS desktop_ready, count(*) FILTER (WHERE NOT ok) AS skipped
    FROM (SELECT *, state = 'Ready' AND NOT needs_render AND revision > 0 AS ok FROM f10_rules) GROUP BY doc_id""")
def _(spark, sf):
    from folio.operators.exporting import exportable_summary
    p = full_pages(spark, sf)
    return exportable_summary(p.withColumn("needs_render", P.needs_render(record(p))))


@query("fil_02_needs_detection", "f10", """
    SELECT page_id FROM f10 WHERE NOT has_quad OR (auto_quad AND detector_version < 2)""")
def _(spark, sf):
    p = T.pages(spark, sf)
    return p.filter(P.needs_detection(F.when(Q("has_quad"), 1), ~Q("auto_quad"), Q("detector_version"))).select("page_id")


@query("fil_03_needs_render", "f10_rules", "SELECT page_id FROM f10_rules WHERE needs_render")
def _(spark, sf):
    p = full_pages(spark, sf)
    return p.filter(P.needs_render(record(p))).select("page_id")


@query("fil_04_has_plain_color_render", "f10_rules", """
    SELECT page_id FROM f10_rules WHERE revision > 0 AND r_mode = 'Color' AND r_brightness = 0 AND r_contrast = 0 AND r_rotation = rotation AND r_turn = turn AND r_free = free
      AND quad IS NOT NULL AND quad IS NOT DISTINCT FROM r_quad AND coalesce(bend, 0) = coalesce(r_bend, 0) AND r_stamps = 0 AND NOT outdated""")
def _(spark, sf):
    p = full_pages(spark, sf)
    return p.filter(P.has_plain_color_render(record(p))).select("page_id")


SEARCH = "The ION"


@query("fil_05_search", "f8", "SELECT doc_id FROM f8 WHERE replace(lower(strip_accents(name)), 'đ', 'd') LIKE '%the%' AND replace(lower(strip_accents(name)), 'đ', 'd') LIKE '%ion%'")
def _(spark, sf):
    return T.documents(spark, sf).filter(N.search(Q("name"), SEARCH)).select("doc_id")


@query("fil_06_home_listing", "f8 f8_folder", """
    SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS docs, 'top' AS view FROM f8 WHERE folder_id IS NULL
    UNION ALL SELECT 'folder', f.folder_id, (SELECT count(*) FROM f8 WHERE f8.folder_id = f.folder_id), 'top' FROM f8_folder f
    UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), NULL, 'search' FROM f8 WHERE replace(lower(strip_accents(name)), 'đ', 'd') LIKE '%muc%'
    UNION ALL SELECT 'folder', f.folder_id, (SELECT count(*) FROM f8 WHERE f8.folder_id = f.folder_id), 'search' FROM f8_folder f
    UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), NULL, 'inside' FROM f8 WHERE folder_id = 'src1'""")
def _(spark, sf):
    from folio.operators.catalogue import home_listing
    d, f = T.documents(spark, sf), T.folders(spark, sf)
    parts = [home_listing(d, f).withColumn("view", F.lit("top")), home_listing(d, f, " Mục ").withColumn("view", F.lit("search")),
             home_listing(d, f, "", "src1").withColumn("view", F.lit("inside"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fil_07_drop_blank", "ink_share", "SELECT image_id, round(ink_percent, 6) AS ink_percent FROM ink_share WHERE NOT (ink_percent < CAST(0.03 AS DOUBLE))")
def _(spark, sf):
    from folio.plans import analyze as A
    d = A.page_ink_percent(T.text_pages(spark, sf))
    return A.drop_blank(d).select("image_id", F.round("ink_percent", 6).alias("ink_percent"))


@query("fil_10_languages", "f9", """
    SELECT page_id, line, k, len(list_filter(string_split(lang, '+'), lambda x: x <> '' AND x NOT IN ('vie', 'eng'))) = 0 AS available
    FROM (SELECT *, CASE k % 4 WHEN 0 THEN 'vie+eng' WHEN 1 THEN 'eng' WHEN 2 THEN 'vie+fra' ELSE text END AS lang FROM f9)""")
def _(spark, sf):
    from folio.operators.words import languages_available
    w = T.words(spark, sf)
    lang = F.when(Q("k") % 4 == 0, "vie+eng").when(Q("k") % 4 == 1, "eng").when(Q("k") % 4 == 2, "vie+fra").otherwise(Q("text"))
    return w.select("page_id", "line", "k", languages_available(lang, ["vie", "eng"]).alias("available"))
