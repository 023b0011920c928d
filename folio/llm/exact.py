"""Exact deduplication through an extendible-hash index on shared files, built of DataFrame operations only.

Building. The 64-bit key of a text is the hash of its normalised form. Equal texts become one
entry by grouping on the key *and the bytes* of the text, which combines copies on the map
side and compares bytes wherever keys collide; texts that share a key without being equal
stay entries of their own and are chained. The directory starts with as many slots as the
number of entries asks for and doubles while a bucket is overfull: a bucket is the shortest
key prefix that holds no more than ``capacity`` entries. Owner tasks each write the key
ranges (buckets) dealt to them, sorted by key, as files in the shared folder.

Probing. Every row finds its entry by key and SHA-256.

Hot groups. A text that makes up a third of all rows is combined before the shuffle into one
entry; its many narrow probe rows are a skewed join, which adaptive execution splits.

Defined results: a null text counts as empty, so null, empty and blank-only rows follow the
same rule as all others (blank-only becomes one space, which differs from empty); repeated
rows are equal texts; a null id ranks after all others and stays only in a group without
ids; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import SPACE, column, same, shared_path, staged, unwrapped, wrapped

#: Entries a bucket may hold before its directory slot splits.
CAPACITY = 50_000
#: A hashed key prefix so many bits longer than needed on average has room for every bucket.
SLACK = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: key, SHA-256, smallest id, rows."""
    rows = docs.select(column(docs, id_col, "long").alias("id"), normalised(column(docs, text_col, "string")).alias("bytes"))
    found = rows.groupBy(F.xxhash64("bytes").alias("key"), "bytes").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.select("key", F.sha2(F.col("bytes").cast("binary"), 256).alias("sha"), "keep_id", "group_size")


def directory(found: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``(slot, bucket, depth)`` and the number of slot bits; ``found`` should be staged.

    Counts per slot of the deepest level are summed over ever longer prefixes; a bucket stops
    splitting at the first depth at which it fits.
    """
    n = found.count()
    wide = max(0, math.ceil(math.log2(max(1, n / capacity))))
    deepest = min(62, wide + SLACK)
    slots = found.groupBy(F.expr(f"shiftrightunsigned(key, {64 - deepest})").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    depth = F.lit(deepest)
    for level in range(deepest - 1, max(-1, wide - 2), -1):
        held = F.sum("n").over(Window.partitionBy(F.shiftright("slot", deepest - level)))
        slots = slots.withColumn(f"held_{level}", held)
        depth = F.when(F.col(f"held_{level}") <= capacity, F.lit(level)).otherwise(depth)
    slots = slots.withColumn("depth", depth)
    return slots.select("slot", "depth", F.expr(f"shiftright(slot, {deepest} - depth)").alias("bucket")), deepest


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> str:
    """Write the index of ``docs`` to the shared folder and return its path.

    Columns: ``depth, bucket`` (a key range), ``key, chain`` (place among different texts with
    this key), ``sha, keep_id, group_size``.
    """
    found = staged(entries(docs, id_col, text_col), "entries")
    slots, bits = directory(found, capacity)
    placed = found.withColumn("slot", F.expr(f"shiftrightunsigned(key, {64 - bits})")).join(slots, "slot")
    chain = Window.partitionBy("depth", "bucket", "key").orderBy("sha")
    owned = placed.repartition("depth", "bucket").withColumn("chain", F.row_number().over(chain))
    path = shared_path(docs.sparkSession, "exact-index")
    owned.select("depth", "bucket", "key", "chain", "sha", "keep_id", "group_size").sortWithinPartitions("depth", "bucket", "key", "chain").write.parquet(path)
    return path


def probed(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row (``__row``) with its ``id, key, sha`` and the entry's ``keep_id, group_size``."""
    rows = wrapped(docs)
    field = lambda c, kind: F.col("__row").getField(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    text = normalised(field(text_col, "string"))
    rows = rows.select("__row", field(id_col, "long").alias("id"), F.xxhash64(text).alias("key"), F.sha2(text.cast("binary"), 256).alias("sha"))
    known = docs.sparkSession.read.parquet(index).select("key", "sha", "keep_id", "group_size")
    return rows.join(known, ["key", "sha"])


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    narrow = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    found = probed(narrow, build(narrow, capacity=capacity))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", same(F.col("id"), F.col("keep_id")).alias("kept"),
                        F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, one for each different text, with the columns of ``docs``."""
    found = probed(docs, build(docs, id_col, text_col, capacity), id_col, text_col)
    kept = found.filter(same(F.col("id"), F.col("keep_id")))
    one = kept.groupBy("key", "sha").agg(F.first("__row").alias("__row"))  # repeated rows carry the same id
    return unwrapped(one, docs.columns)
