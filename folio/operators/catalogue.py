"""Operators on page and document tables: splitting, naming, ordering, edits, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import naming as N
from folio.operators.ordered import block, numbered, running_sums
from folio.session import checkpointed


# --- splitting a batch -------------------------------------------------------------

def document_groups(pages: DataFrame, mode: str = "blank", prefix: str = "", keep_separators: bool = False) -> DataFrame:
    """Pages with ``doc_no`` (1.. per batch) and the ``doc_barcode`` that opened their document.

    Input ``batch_id, pos, is_blank, barcode``. A separator starts a document; blank sheets
    are always dropped, barcode sheets unless kept; documents without pages disappear; the
    code on a sheet belongs to the pages after it.
    """
    if mode == "none":
        return pages.withColumns({"doc_no": F.lit(1).cast("bigint"), "doc_barcode": F.lit(None).cast("string")})
    if mode == "blank":
        sep, code = F.col("is_blank"), F.lit(None).cast("string")
    else:
        sep = F.col("barcode").isNotNull() & F.startswith(F.lower("barcode"), F.lit(prefix.lower()))
        code = F.col("barcode")
    d = running_sums(pages.withColumn("_sep", sep), "batch_id", block("pos"), ["pos"],
                     {"_group": F.when(F.col("_sep"), 1).otherwise(0).cast("bigint")})
    dropped = F.col("_sep") & F.lit(mode == "blank" or not keep_separators)
    groups = d.groupBy("batch_id", "_group").agg(F.max(F.when(F.col("_sep"), code)).alias("doc_barcode"),
                                                 F.count_if(~dropped).alias("_pages"))
    groups = numbered(groups.filter("_pages > 0"), "batch_id", block("_group"), ["_group"], "doc_no").drop("_pages")
    return d.filter(~dropped).join(groups, ["batch_id", "_group"]).drop("_sep", "_group")


def batch_counter(docs: DataFrame) -> DataFrame:
    """``batch_id, doc_no, pages, counter``: 1, 2, 3... over the documents of each batch."""
    return docs.groupBy("batch_id", "doc_no").agg(F.count(F.lit(1)).alias("pages"), F.first("doc_barcode").alias("doc_barcode")).withColumn(
        "counter", F.col("doc_no"))


def _used_numbers(taken: DataFrame, pattern: str) -> DataFrame:
    """``_stem, _u``: the number of a stem that an existing name uses up, as itself (1) and as a suffixed form."""
    t = F.lower("name")
    own = taken.select(t.alias("_stem"), F.lit(1).cast("bigint").alias("_u"))
    more = taken.select(F.regexp_extract(t, pattern, 1).alias("_stem"), F.regexp_extract(t, pattern, 2).try_cast("bigint").alias("_u")).filter("_u >= 2")
    return own.unionByName(more).distinct()


def _numbered_past(d: DataFrame, used: DataFrame) -> DataFrame:
    """Adds ``_n``: the ``_k``-th number of the row's stem that ``used`` leaves free."""
    free = numbered(used, "_stem", block("_u"), ["_u"], "_r")
    marks = free.select("_stem", (F.col("_u") - F.col("_r")).alias("_v"), F.lit(1).alias("_used"))
    both = marks.unionByName(d.select("_stem", F.col("_k").alias("_v"), F.lit(0).alias("_used")))
    run = running_sums(both, "_stem", block("_v"), ["_v", "_used"], {"_shift": F.col("_used").cast("bigint")})
    shift = run.filter("_used = 0").select(F.col("_stem").alias("_s"), F.col("_v").alias("_kk"), "_shift")
    return (d.join(shift, (F.col("_stem") == F.col("_s")) & (F.col("_k") == F.col("_kk")))
            .withColumn("_n", F.col("_k") + F.col("_shift")).drop("_s", "_kk", "_shift"))


def unique_names(names: DataFrame, taken: DataFrame | None, chunk: Column, order: list[str], style: str = "_{}") -> DataFrame:
    """Adds ``unique_name``: the first taker of a name keeps it, later ones get suffix 2, 3, ...

    ``names`` has ``name`` and the ``order`` columns (``chunk`` cuts that order and ends with a
    unique one), ``taken`` has existing ``name`` values. The k-th new holder of a stem gets the
    k-th number still free there. A suffixed name may equal a new name of another stem
    (``Scan_2``): the row that comes first keeps it, and the number counts as used for the
    other's stem; this repeats until all names differ. Names compare without case, as the
    file system does.
    """
    pattern = r"^(.*)_([0-9]+)$" if style == "_{}" else r"^(.*) \(([0-9]+)\)$"
    before, after = style.split("{}")
    d = checkpointed(numbered(names.withColumn("_stem", F.lower("name")), "_stem", chunk, order, "_k"))
    used = None if taken is None else checkpointed(_used_numbers(taken, pattern))
    # only a new name that reads like a suffixed form of another new one can clash
    forms = d.select(F.regexp_extract("_stem", pattern, 1).alias("_stem")).filter("_stem <> ''").distinct()
    risky = bool(forms.join(d.select("_stem"), "_stem", "left_semi").take(1))
    while True:
        out = d.withColumn("_n", F.col("_k")) if used is None else _numbered_past(d, used)
        name = F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat("name", F.lit(before), F.col("_n").cast("string"), F.lit(after)))
        out = out.withColumn("unique_name", name)
        if not risky:
            break
        out = checkpointed(out)
        place = F.struct(*order)
        first = out.groupBy(F.lower("unique_name").alias("_u_name")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
        late = out.withColumn("_u_name", F.lower("unique_name")).join(first, "_u_name").filter(place > F.col("_first"))
        late = late.groupBy("_stem").agg(F.min("_n").alias("_u"))  # later numbers of the stem move along
        if not late.take(1):
            break
        used = checkpointed(late if used is None else used.unionByName(late).distinct())
    return out.drop("_stem", "_k", "_n")


# --- order inside a document -------------------------------------------------------

def _after(at: Column, step: Column) -> Column:
    """Where a page at ``at`` stands after the page at ``step.f`` went to ``step.t``."""
    f, t = step["f"], step["t"]
    return (F.when(at == f, t).when((f < at) & (at <= t), at - 1).when((t <= at) & (at < f), at + 1).otherwise(at))


def move_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds ``new_index`` after moving pages to (clamped) indices, one move after the other.

    ``pages``: ``doc_id, page_id, index`` (0-based); ``moves``: ``doc_id, page_id, to`` and, where a
    document has several, ``seq``, their order; moves of pages that are not there are left out.
    The moves of a document, a list of user edits, fold into steps (from, to), and every page
    folds its index over the steps of its document: one job, whatever the number of moves.
    """
    seq = F.col("seq") if "seq" in moves.columns else F.lit(0)
    m = moves.select(F.col("doc_id").alias("_doc"), F.col("page_id").alias("_page"), F.col("to").cast("bigint").alias("_to"), seq.alias("_seq"))
    size = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    begun = m.join(pages.select("doc_id", "page_id", F.col("index").cast("bigint").alias("_i")), (F.col("doc_id") == F.col("_doc")) & (F.col("page_id") == F.col("_page")))
    begun = begun.select("_doc", "_seq", "_i", "_to").join(size, F.col("_doc") == F.col("doc_id"))
    to = F.least(F.greatest(F.col("_to"), F.lit(0)), F.col("_n") - 1)
    lists = begun.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct(F.col("_seq").alias("s"), F.col("_i").alias("i"), to.alias("t")))).alias("_moves"))
    none = F.array().cast("array<struct<f:bigint,t:bigint>>")
    steps = F.aggregate("_moves", none, lambda done, x: F.concat(done, F.array(F.struct(F.aggregate(done, x["i"], _after).alias("f"), x["t"].alias("t")))))
    d = pages.join(lists.select("_doc", steps.alias("_steps")), F.col("doc_id") == F.col("_doc"), "left")
    moved = F.aggregate(F.coalesce("_steps", none), F.col("index").cast("bigint"), _after)
    return d.withColumn("new_index", moved).drop("_doc", "_steps")


def insert_at(pages: DataFrame, inserts: DataFrame) -> DataFrame:
    """Existing and inserted pages with ``new_index``: each insert goes before its (clamped) index.

    ``inserts``: ``doc_id, page_id, at``, any number for a document. They go in by ascending
    index (then id): the j-th stands behind ``m`` existing pages, ``m`` being the largest of
    ``min(at_i, n + i) - i`` up to it; an existing page moves up by the inserts at or before it.
    """
    size = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    w = Window.partitionBy("doc_id").orderBy("_at", "page_id")
    ins = inserts.join(size, "doc_id", "left").select("doc_id", "page_id", n.alias("_n"), F.greatest(F.coalesce("at", F.lit(1 << 40)), F.lit(0)).alias("_at"))
    ins = ins.withColumn("_j", (F.row_number().over(w) - 1).cast("bigint"))
    kept = F.least(F.col("_at"), F.col("_n") + F.col("_j")) - F.col("_j")
    ins = ins.withColumn("_m", F.max(kept).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = ins.select("doc_id", "page_id", F.col("_m").cast("bigint").alias("_at"), F.lit(0).alias("_old"), (F.col("_m") + F.col("_j")).alias("_f")).unionByName(
        pages.select("doc_id", "page_id", F.col("index").cast("bigint").alias("_at"), F.lit(1).alias("_old"), F.lit(None).cast("bigint").alias("_f")))
    run = running_sums(both, "doc_id", block("_at"), ["_at", "_old"], {"_before": (1 - F.col("_old")).cast("bigint")})
    return run.select("doc_id", "page_id", F.when(F.col("_old") == 1, F.col("_at") + F.col("_before")).otherwise(F.col("_f")).alias("new_index"))


def set_order(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``new_index``: listed pages first in list order, the rest after in their old order."""
    w = wanted.groupBy("doc_id", "page_id").agg(F.min("rank").alias("_rank"))
    d = pages.join(w, ["doc_id", "page_id"], "left")
    d = d.withColumn("_late", F.col("_rank").isNull()).withColumn("_o", F.coalesce("_rank", "index"))
    chunk = F.when(F.col("_late"), F.lit(1 << 40)).otherwise(0) + F.floor(F.col("_o") / 4096)
    d = numbered(d, "doc_id", chunk, ["_late", "_o"], "new_index")
    return d.withColumn("new_index", F.col("new_index") - 1).drop("_rank", "_late", "_o")


# --- latest state ------------------------------------------------------------------

def latest(log: DataFrame, key: str, version: list[str], as_of: Column | None = None) -> DataFrame:
    """Last record per key by version, optionally as of a moment; partial maxima combine first."""
    d = log if as_of is None else log.filter(as_of)
    rest = [c for c in d.columns if c != key]
    pick = F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")
    return d.groupBy(key).agg(pick).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def guarded_update(pages: DataFrame, results: DataFrame, key: str, guard: list[str], values: list[str]) -> DataFrame:
    """Late results applied only where the page still has the inputs they were computed from."""
    r = results.select(F.col(key).alias("_k"), *[F.col(g).alias(f"_g_{g}") for g in guard], *[F.col(v).alias(f"_v_{v}") for v in values])
    d = pages.join(r, F.col(key) == F.col("_k"), "left")
    ok = F.col("_k").isNotNull()
    for g in guard:
        ok = ok & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    d = d.withColumn("applied", ok)
    return d.withColumns({v: F.when(F.col("applied"), F.col(f"_v_{v}")).otherwise(F.col(v)) for v in values}).drop(
        "_k", *[f"_g_{g}" for g in guard], *[f"_v_{v}" for v in values])


# --- catalogue look-ups ------------------------------------------------------------

def with_valid_folder(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """A folder that no longer exists means the top level."""
    f = folders.select(F.col("folder_id").alias("_f")).distinct()
    return docs.join(f, F.col("folder_id") == F.col("_f"), "left").withColumn("folder_id", F.col("_f")).drop("_f")


def move_to_folder(docs: DataFrame, moves: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents filed elsewhere; moves into unknown folders are ignored, null is the top level.

    Of several moves of a document the one with the latest ``ts`` counts (without ``ts``, the last folder by name)."""
    last = F.max_by("target", "ts") if "ts" in moves.columns else F.max("target")
    m = moves.groupBy("doc_id").agg(last.alias("_t")).withColumn("_m", F.lit(True))
    f = folders.select(F.col("folder_id").alias("_f")).distinct()
    m = m.join(f, F.col("_t") == F.col("_f"), "left").filter(F.col("_t").isNull() | F.col("_f").isNotNull()).drop("_f")
    d = docs.join(m, "doc_id", "left")
    return d.withColumns({"moved": F.coalesce("_m", F.lit(False)),
                          "folder_id": F.when(F.col("_m"), F.col("_t")).otherwise(F.col("folder_id"))}).drop("_t", "_m")


def home_listing(docs: DataFrame, folders: DataFrame, query: str = "", folder: str | None = None) -> DataFrame:
    """Rows of the main screen: matching folders with counts (top level only), then documents."""
    searching = bool(query.strip())
    shown = docs.filter(N.search(F.col("name"), query)) if searching else docs
    if folder is not None:
        shown = shown.filter(F.col("folder_id") == folder)
    elif not searching:
        shown = shown.filter("folder_id IS NULL")
    rows = shown.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("bigint").alias("docs"))
    if folder is not None:
        return rows
    counts = docs.groupBy(F.col("folder_id").alias("_f")).agg(F.count(F.lit(1)).alias("docs"))
    f = folders.filter(N.search(F.col("folder_name"), query)).join(counts, F.col("folder_id") == F.col("_f"), "left")
    return f.select(F.lit("folder").alias("kind"), F.col("folder_id").alias("id"), F.coalesce("docs", F.lit(0)).alias("docs")).unionByName(rows)


def scan_profile_dpi(jobs: DataFrame, profiles: DataFrame, default_name: str) -> DataFrame:
    """``target_dpi`` of each job: its profile by name, else the default one, else the first; 300 if unusable.

    Profiles are a settings list (fixed size); the fall-backs are one-row aggregates.
    """
    p = profiles.groupBy(F.lower("profile").alias("_p")).agg(F.min_by("dpi", "ord").alias("_dpi"))
    fall = profiles.agg(F.min_by("dpi", F.struct(F.when(F.lower("profile") == default_name.lower(), 0).otherwise(1), F.col("ord"))).alias("_fallback"))
    d = jobs.join(p, F.lower("profile") == F.col("_p"), "left").join(fall)
    dpi = F.coalesce("_dpi", "_fallback")
    return d.withColumn("target_dpi", F.when(dpi >= 50, dpi).otherwise(300)).drop("_p", "_dpi", "_fallback")


def perf_totals(perf: DataFrame) -> DataFrame:
    """``name, total_ms, runs, median_ms, min_ms, max_ms``; the upper median from a level histogram."""
    hist = perf.groupBy("name", "ms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("name").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy("name")
    h = hist.withColumn("acc", F.sum("n").over(w)).withColumn("runs", F.sum("n").over(all_))
    return h.groupBy("name").agg(
        F.sum(F.col("ms").cast("bigint") * F.col("n")).alias("total_ms"), F.first("runs").alias("runs"),
        F.min(F.when(F.col("acc") >= F.floor(F.col("runs") / 2) + 1, F.col("ms"))).alias("median_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


# --- edits -------------------------------------------------------------------------

def apply_filter_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Last value set per field wins; fields an edit leaves null keep their value; numbers are clamped."""
    limits = {"darkness": (0, 100), "brightness": (-100, 100), "contrast": (-100, 100)}
    fields = ["mode", "darkness", "brightness", "contrast"]
    last = edits.groupBy("page_id").agg(*[
        F.max_by(F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}")),
                 F.when(F.col(f"new_{f}").isNotNull(), F.struct("ts", "seq"))).alias(f"_{f}") for f in fields])
    d = pages.join(last, "page_id", "left")
    value = lambda f: F.least(F.greatest(F.col(f"_{f}"), F.lit(limits[f][0])), F.lit(limits[f][1])) if f in limits else F.col(f"_{f}")
    return d.withColumns({f: F.when(F.col(f"_{f}").isNotNull(), value(f)).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def apply_rotations(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns of a page added up: outline and proxy size turn along; only Ready pages, which go Pending."""
    from folio.functions.geometry import rotate_quad
    turns = edits.groupBy("page_id").agg(F.pmod(F.sum((F.col("degrees") / 90).cast("int")), F.lit(4)).alias("_t"))
    d = pages.join(turns, "page_id", "left")
    t = F.when(F.col("state") == "Ready", F.coalesce("_t", F.lit(0))).otherwise(0)
    d = d.withColumn("_t", t)
    odd = F.col("_t") % 2 == 1
    return d.withColumns({
        "quad": rotate_quad(F.col("quad"), F.col("_t")), "rotation": ((F.col("rotation") + F.col("_t") * 90) % 360).cast("int"),
        "pw": F.when(odd, F.col("ph")).otherwise(F.col("pw")), "ph": F.when(odd, F.col("pw")).otherwise(F.col("ph")),
        "state": F.when(F.col("_t") != 0, "Pending").otherwise(F.col("state"))}).drop("_t")


def renamed(rows: DataFrame, edits: DataFrame, key: str, default: str) -> DataFrame:
    """Last non-blank name, trimmed; rows created without one get the default."""
    e = edits.withColumn("_n", N.blank_to_null(F.col("new_name"))).filter("_n IS NOT NULL")
    last = e.groupBy(key).agg(F.max_by("_n", F.struct("ts", "seq")).alias("_n"))
    return rows.join(last, key, "left").withColumn(
        "name", F.coalesce("_n", N.blank_to_null(F.col("name")), F.lit(default))).drop("_n")


def restore_pages(pages: DataFrame, trash: DataFrame) -> DataFrame:
    """Trashed pages back at their old, clamped index; one being imported comes back failed."""
    back = insert_at(pages.select("doc_id", "page_id", "index"), trash.select("doc_id", "page_id", F.col("index").alias("at")))
    states = pages.select("page_id", "state").unionByName(
        trash.select("page_id", F.when(F.col("state") == "Importing", "Failed").otherwise(F.col("state")).alias("state")))
    return back.join(states, "page_id")
