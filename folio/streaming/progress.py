"""Imports, page stages, export counters, bursts and timings as they happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.catalogue import document_groups, latest
from folio.operators.ordered import block, running_sums
from folio.streaming import state as ST

# fixed values
LEGAL = {"Importing": ("Pending", "Failed"), "Pending": ("Preview", "Failed"), "Preview": ("Ready", "Failed"),
         "Ready": ("Pending",), "Failed": ("Pending",)}
OCR_QUIET = "2 seconds"
SAVE_QUIET = "400 milliseconds"
COPY_STEP = 0.04


# --- page stages -------------------------------------------------------------------

def next_stage(state: Column, needs_detection: Column, has_quad: Column, needs_render: Column) -> Column:
    """What an interrupted page does next; null when nothing is left."""
    return (F.when(state == "Pending", "Thumb").when(state == "Preview", "Proxy")
            .when((state == "Ready") & needs_detection, "Detect").when((state == "Ready") & has_quad & needs_render, "Prerender"))


def legal_move(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for a, bs in LEGAL.items():
        out = out | ((old == a) & new.isin(*bs))
    return out


def page_states(events: DataFrame) -> DataFrame:
    """``page_id, state``: last reported state per page (batch)."""
    return latest(events, "page_id", ["ts", "seq"]).select("page_id", "state")


def _progress_step(s: dict, r) -> tuple[dict, tuple]:
    ok = s["state"] is None or r.state in LEGAL[s["state"]]
    return ({"state": r.state} if ok else s), (s["state"], ok)


PROGRESS_OUT = "page_id string, seq long, state string, before string, applied boolean"


def page_progress(events: DataFrame, live: bool = False) -> DataFrame:
    """Each stage report with the state before it; illegal moves are refused."""
    run = ST.stream if live else ST.batch
    return run(events.select("page_id", "seq", "state"), "page_id", "seq", ["seq", "state"], _progress_step, {"state": None},
               PROGRESS_OUT, ["before", "applied"])


# --- counters ----------------------------------------------------------------------

def import_progress(events: DataFrame) -> DataFrame:
    """Live counters per document (update mode on a stream): the same aggregate in both worlds."""
    waiting, failed = F.col("state") == "Importing", F.col("state") == "Failed"
    return events.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~waiting).alias("done"), F.count_if(failed).alias("failures"))


def copy_share(copied: Column, size: Column) -> Column:
    """Reported share of a copy, in whole steps."""
    return F.floor(copied / F.greatest(F.lit(1), size) / COPY_STEP + 1e-9) * COPY_STEP


def _export_step(s: dict, r) -> tuple[dict, tuple]:
    if not r.finished:
        return s, (max(0, 5 - s["used"]), False)
    used, n = s["used"] + (0 if r.is_pro else 1), s["n"] + 1
    due = n >= 5
    return {"used": used, "n": 0 if due else n}, (max(0, 5 - used), due and not r.is_pro)


EXPORT_OUT = "install long, event_id long, finished boolean, remaining int, due boolean"


def export_gates(events: DataFrame, live: bool = False) -> DataFrame:
    """Remaining free exports and whether a break is due, after each export attempt.

    A table needs no state: both follow from running counts, so a hot install spans many tasks.
    """
    rows = events.select("install", "event_id", "finished", "is_pro")
    if live:
        return ST.stream(rows, "install", "event_id", ["event_id", "finished"], _export_step, {"used": 0, "n": 0}, EXPORT_OUT, ["remaining", "due"])
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    done = F.col("finished")
    d = running_sums(rows, "install", block("event_id"), ["event_id", "finished"], {"_used": one(done & ~F.col("is_pro")), "_n": one(done)})
    return d.select("install", "event_id", "finished", F.greatest(F.lit(0), 5 - F.col("_used")).cast("int").alias("remaining"),
                    (done & ~F.col("is_pro") & (F.col("_n") % 5 == 0)).alias("due"))


# --- bursts and timings ------------------------------------------------------------

def debounce(signals: DataFrame, key: str, quiet: str = OCR_QUIET, late: str | None = None) -> DataFrame:
    """One row per burst: bursts end after ``quiet`` without a signal. ``late`` sets a watermark on streams."""
    d = signals.withWatermark("ts", late) if late else signals
    g = d.groupBy(F.session_window("ts", quiet).alias("burst"), key).agg(F.count(F.lit(1)).alias("signals"), F.max("ts").alias("last_ts"))
    return g.select(key, F.col("burst.start").alias("start_ts"), "last_ts", "signals")


def perf_windows(perf: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Stage totals per tumbling window."""
    d = perf.withWatermark("ts", late) if late else perf
    g = d.groupBy(F.window("ts", size).alias("win"), "name").agg(F.sum("ms").alias("total_ms"), F.count(F.lit(1)).alias("runs"))
    return g.select(F.col("win.start").alias("start_ts"), "name", "total_ms", "runs")


# --- splitting as pages arrive -----------------------------------------------------

SPLIT_OUT = "batch_id long, page_id string, doc_no long, doc_barcode string, kept boolean"


def _split_step(s: dict, r) -> tuple[dict, tuple]:
    if not r.sep:
        if not s["open"]:  # the first page of a document gives it its number
            s = s | {"open": True, "no": s["no"] + 1}
        return s, (s["no"], s["code"], True)
    return s | {"open": False, "code": r.barcode}, (None, None, False)


def stream_split(pages: DataFrame, prefix: str = "", live: bool = False) -> DataFrame:
    """Separator sheets (barcode with ``prefix``) start a document; numbers follow pages as they arrive."""
    if not live:
        d = document_groups(pages, "barcode", prefix)
        return d.select("batch_id", "page_id", F.col("doc_no").cast("bigint").alias("doc_no"), "doc_barcode")
    sep = F.col("barcode").isNotNull() & F.startswith(F.lower("barcode"), F.lit(prefix.lower()))
    d = ST.stream(pages.select("batch_id", "pos", "page_id", "barcode", sep.alias("sep")), "batch_id", "pos", ["page_id"], _split_step,
                  {"no": 0, "open": False, "code": None}, SPLIT_OUT, ["doc_no", "doc_barcode", "kept"])
    return d.filter("kept").drop("kept")


# --- ingest ------------------------------------------------------------------------

def ingested(pages: DataFrame, analyze, fault: Column, key: str = "image_id") -> DataFrame:
    """Catalogue rows of new pages: what ``analyze`` makes of the sound ones (``Ready``), and the others as they are (``Failed``).

    ``fault`` tells from a page's own columns what is wrong with it, null when nothing is; a
    damaged page never reaches the analysis, so it can't fail those beside it.
    """
    d = pages.withColumn("error", fault)
    ready = analyze(d.filter("error IS NULL").drop("error")).withColumns({"state": F.lit("Ready"), "error": F.lit(None).cast("string")})
    return ready.unionByName(d.filter("error IS NOT NULL").select(key, F.lit("Failed").alias("state"), "error"), allowMissingColumns=True)


def _isolated(batch: DataFrame, save, failed, key: str, depth: int = 0) -> None:
    """``save`` the batch; where that raises, halve it until the rows that make it raise stand alone, and give those to ``failed``."""
    try:
        save(batch)
    except Exception as e:  # whatever a page made the analysis raise
        if depth >= 40 or batch.select(key).distinct().limit(2).count() < 2:
            failed(batch, next((x.strip() for x in str(e).splitlines() if "Error" in x), type(e).__name__)[:200])
            return
        half = F.pmod(F.shiftright(F.xxhash64(key), depth), F.lit(2))
        for k in (0, 1):
            part = batch.filter(half == k)
            if part.take(1):
                _isolated(part, save, failed, key, depth + 1)


def incremental_ingest(pages: DataFrame, analyze, target: str, checkpoint: str, key: str | None = None):
    """New page rows through ``analyze`` into a table, once per micro-batch.

    The batch number names its folder, which is emptied before a retry, so a lost executor or a
    restart never doubles rows. With ``key`` a page that makes the analysis raise is saved as a
    ``Failed`` row with its message while the rest of its batch goes through: the batch is halved
    around it, a number of jobs in proportion to the bad pages.
    """
    def write(batch: DataFrame, number: int) -> None:
        at = f"{target}/batch={number}"
        if key is None:
            analyze(batch).write.mode("overwrite").parquet(at)
            return
        spark = batch.sparkSession
        spark.createDataFrame([], "state string").write.mode("overwrite").parquet(at)  # of an attempt cut off
        state = lambda d, s, e: d.withColumns({"state": F.lit(s), "error": F.lit(e).cast("string")})
        _isolated(batch, lambda d: state(analyze(d), "Ready", None).write.mode("append").parquet(at),
                  lambda d, said: state(d.select(key), "Failed", said).write.mode("append").parquet(at), key)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
