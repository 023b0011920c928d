"""Benchmark decontamination by a prefix-filtered set join, of DataFrame operations only.

Every item is cut into windows of ``window`` words (an item with fewer words is one window).
A window is the set of its word shingles; it occurs in a document only if *all* of them do, so
at a containment of 1 the prefix that a match needs is a single shingle. Shingles are ordered
by rarity, counted over all documents, and only the rarest of each window is joined with the
shingles of the documents. Bounds follow at once: the window has to begin at or after the
document's first word (position) and end at or before its last (length). Then the words
themselves are compared over the window's extent, so the result is exact.

Documents are never shuffled with their text: the windows come to them. A broadcast is used
only in blocks of at most ``block`` rows, each of a few hundred bytes; a larger benchmark takes
several blocks, and every block is joined with all documents.

Defined results: a null or wordless text has no words and no hits; an item without words has no
windows; a null item id takes part under its empty name; repeated items with the same id count
once; repeated documents each get their own row; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, same, staged, unwrapped, wrapped

WINDOW = 10
SHINGLE = 3
#: Rows of a broadcast block. A window row holds its words, so a block stays in the tens of MB.
BLOCK = 50_000
#: What separates words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is (``lower`` does the same, faster, where a text is ASCII)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _split(rows: DataFrame, *keep: str) -> DataFrame:
    """``words`` of ``rows(text)`` with the indices of the first and last real word (splitting can leave an empty one at either end)."""
    rows = rows.select(*keep, F.split(lowered(F.coalesce("text", F.lit(""))), BETWEEN).alias("words"))
    size = F.size("words")
    first = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    return rows.withColumns({"first": first, "last": size - F.when(F.get("words", size - 1) == "", 2).otherwise(1)})


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Different windows: ``phrase`` (the words, space-joined), ``words``, ``size`` and the ``items`` that hold it."""
    rows = benchmark.select(F.coalesce(column(benchmark, id_col, "string"), F.lit("")).alias("item"), column(benchmark, text_col, "string").alias("text"))
    rows = _split(rows, "item").filter("last >= first")
    at = F.explode(F.sequence(F.col("first"), F.greatest(F.col("first"), F.col("last") - (window - 1))))
    rows = rows.select("item", "words", "last", at.alias("at"))
    part = F.slice("words", F.col("at") + 1, F.least(F.lit(window), F.col("last") - F.col("at") + 1))
    found = rows.select("item", F.array_join(part, " ").alias("phrase")).groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))
    words = F.split("phrase", " ")
    return found.select("phrase", words.alias("words"), F.size(words).alias("size"), "items")


def _token(k: int) -> Column:
    return F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(k)])


def _positions(rows: DataFrame, k: int) -> DataFrame:
    """A row for each shingle of ``k`` words of ``rows(words, first, last)``: its place ``at`` and ``token``."""
    places = F.when(F.col("last") - F.col("first") >= k - 1, F.sequence(F.col("first"), F.col("last") - (k - 1)))
    return rows.withColumn("at", F.explode(places)).withColumn("token", _token(k))


def _blocks(rows: DataFrame, block: int) -> list[DataFrame]:
    """``rows`` in parts of about ``block`` rows at most, each small enough to broadcast."""
    n = rows.count()
    if not n:
        return []
    parts = -(-n // block)
    return [rows] if parts == 1 else [rows.filter(F.pmod(F.xxhash64(F.lit(17), "token"), F.lit(2 * parts)) == i) for i in range(2 * parts)]


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def prefixes(docs: DataFrame, wins: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """``wins`` with the rarest shingle over all documents: ``token``, its place ``off`` in the window, its words ``k``."""
    kinds = sorted(r[0] for r in wins.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # of 1, 2 and 3
    best = []
    for k in kinds:
        own = wins.filter(F.least("size", F.lit(SHINGLE)) == k).withColumns({"first": F.lit(0), "last": F.col("size") - 1})
        tokens = _positions(own, k).select("phrase", "size", "items", F.col("at").alias("off"), "token")
        wanted = staged(tokens.select("token").distinct(), "tokens")
        seen = [_positions(_split(docs), k).select("token").join(F.broadcast(part), "token").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
                for part in _blocks(wanted, block)]
        rare = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "off")).alias("r")
        found = tokens.join(_all(seen), "token", "left").groupBy("phrase").agg(rare, F.first("size").alias("size"), F.first("items").alias("items"))
        best.append(found.select("phrase", "size", "items", F.lit(k).alias("k"), F.col("r.token").alias("token"), F.col("r.off").alias("off")))
    return staged(_all(best), "prefixes") if best else None


def occurrences(docs: DataFrame, wins: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """``(id, mark, start, size, items)``: every place of ``docs(id, mark, text)`` where a window occurs."""
    needed = prefixes(docs, wins, block)
    found = []
    for k in range(1, SHINGLE + 1) if needed is not None else ():
        for part in _blocks(needed.filter(F.col("k") == k).drop("k"), block):
            met = _positions(_split(docs, "id", "mark"), k).join(F.broadcast(part), "token")
            start = F.col("at") - F.col("off")
            bounds = (start >= F.col("first")) & (start + F.col("size") - 1 <= F.col("last"))
            equal = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("phrase")
            found.append(met.filter(bounds & equal).select("id", "mark", (start - F.col("first")).alias("start"), "size", "items"))
    return _all(found) if found else None


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows known by id and hash of the text: rows that agree in both have the same result."""
    text = column(docs, text_col, "string")
    return docs.select(column(docs, id_col, "long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """``(id, mark, n_hit, found)`` of each document with a hit: words inside a window, item ids in order. None without windows."""
    wins = staged(windows(benchmark, window), "windows")
    met = occurrences(_keyed(docs, id_col, text_col), wins, block)
    if met is None:
        return None
    met = staged(met, "occurrences")
    covered = met.select("id", "mark", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    covered = covered.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n_hit"))
    items = met.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), F.explode("items").alias("item")).distinct()
    items = items.groupBy("id2", "mark2").agg(F.array_sort(F.collect_list("item")).alias("found"))
    return covered.join(items, same(F.col("id"), F.col("id2")) & (F.col("mark") == F.col("mark2"))).select("id", "mark", "n_hit", "found")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = _split(_keyed(docs, id_col, text_col), "id", "mark").select(
        F.col("id").alias("doc_id"), F.col("mark").alias("own"), F.greatest(F.lit(0), F.col("last") - F.col("first") + 1).cast("long").alias("n_words"))
    met = overlaps(docs, benchmark, window, block, id_col, text_col)
    if met is None:
        rows = rows.withColumns({"n_hit": F.lit(None).cast("long"), "found": F.lit(None).cast("array<string>")})
    else:
        rows = rows.join(met, same(F.col("doc_id"), F.col("id")) & (F.col("own") == F.col("mark")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
                       F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    met = overlaps(docs, benchmark, window, block, id_col, text_col)
    if met is None:
        return docs
    own = wrapped(docs)
    own = own.select("__row", F.col("__row").getField(id_col).cast("long").alias("__id"), F.xxhash64(F.col("__row").getField(text_col).cast("string")).alias("__mark"))
    return unwrapped(own.join(met, same(F.col("__id"), F.col("id")) & (F.col("__mark") == F.col("mark")), "left_anti"), docs.columns)
