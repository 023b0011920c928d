"""SimHash near-duplicates found by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits are cut into two 32-bit segments: in
at least one segment they differ in at most one bit. Each segment value is indexed under its
32 variants with one bit blanked, and two values that differ in at most one bit share a
variant, so one equality join finds every pair; the whole fingerprints are then compared.

Copies collapse to one fingerprint before anything is joined. A fingerprint has at most 2,080
others within two bits, so links stay proportional to fingerprints. A variant shared by more
than ``crowd`` fingerprints is not paired as it stands: within it the other segment differs
in at most two bits, so of three pieces of that segment one is equal, and the crowd is split
by (piece, value), without losing a pair.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any
other; ties and repeated rows share their fingerprint; a null id never becomes the class of
others with ids; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import column, same, staged, unwrapped, wrapped
from folio.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 2
#: Distinct fingerprints sharing one variant that are still paired directly.
CROWD = 64
#: Shingles hashed and counted at once: bounds the memory of a very long text.
STEP = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text (its UTF-8) as a signed 64-bit number."""
    parts = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not parts:
        return 0
    if len(parts) < size:
        body = b" ".join(parts)
        starts, ends = [0], [len(body)]
    else:
        body = b" ".join(parts)
        widths = np.fromiter(map(len, parts), np.int64, len(parts))
        stops = np.cumsum(widths + 1) - 1
        starts = (stops - widths)[: len(parts) - size + 1].tolist()
        ends = stops[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        hashes = [digest(body[s:e], SEED) for s, e in zip(starts[at:at + STEP], ends[at:at + STEP])]
        wide = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(wide, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(starts)).astype(np.uint8))
    return int(bits.view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("__text"))
        found = pa.array((fingerprint(t.as_py()) for t in texts), pa.int64(), size=len(texts))
        rest = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in rest], found], names=[*rest, "__fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row, from whole texts."""
    rows = docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").cast("binary").alias("__text"))
    return rows.mapInArrow(_fingerprints, "id long, __fp long").withColumnRenamed("__fp", "fp")


def _variants(fp: Column) -> Column:
    """Keys of the 64 variants: segment, blanked bit and the segment's other bits, packed into 38 bits."""
    keys = []
    for seg in (0, 1):
        value = F.shiftrightunsigned(fp, 32 * seg).bitwiseAND(0xFFFFFFFF)
        keys += [value.bitwiseAND(0xFFFFFFFF ^ (1 << bit)) + F.lit((seg * 32 + bit) << 32) for bit in range(32)]
    return F.array(*keys)


def links(marks: DataFrame, crowd: int = CROWD, bits: int = BITS) -> DataFrame:
    """``(a, b)``, a > b: all pairs of the different fingerprints ``marks(fp)`` within ``bits`` (at most 2) bits."""
    rows = marks.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    other = F.when(F.col("key") < F.lit(32 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(0xFFFFFFFF)
    pieces = F.array(*[(other.bitwiseAND(mask) + F.lit(k << 32)) for k, mask in enumerate((0x7FF, 0x3FF800, 0xFFC00000), start=1)])
    part = F.when(F.col("n") > crowd, pieces).otherwise(F.array(F.lit(0).cast("long")))
    rows = staged(rows.select("fp", "key", F.explode(part).alias("part")), "variants")
    left = rows.select("key", "part", F.col("fp").alias("a"))
    right = rows.select("key", "part", F.col("fp").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    in_segment = F.when(left["key"] < F.lit(32 << 32), apart.bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(apart, 32))
    first = (F.shiftright(left["key"], 32) % 32 == 0) | (in_segment != 0)  # equal segments share all variants: one is enough
    near = (F.bit_count(apart) <= bits) & first
    return left.join(right, (left["key"] == right["key"]) & (left["part"] == right["part"]) & (F.col("a") > F.col("b")) & near
                     ).select("a", "b").distinct()


def classes(marks: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(fp, component_id)`` from staged ``marks(id, fp)``: the smallest id that a chain of links reaches."""
    least = staged(marks.groupBy("fp").agg(F.min("id").alias("least")), "least")
    roots = components(links(least.select("fp"), crowd))
    joined = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(best, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    marks = staged(fingerprints(docs, id_col, text_col), "marks")
    found = marks.join(classes(marks, crowd), "fp")
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """The document with the smallest id of each class, with the columns of ``docs``.

    The same id on rows of different texts counts as one document: of its rows in the class
    that with the smallest fingerprint, then hash, stays; of repeated rows one. A class
    without ids keeps one row of each fingerprint.
    """
    text, ident = column(docs, text_col, "string"), column(docs, id_col, "long")
    rows = docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("h"), text.cast("binary").alias("__text"))
    marks = staged(rows.mapInArrow(_fingerprints, "id long, h long, __fp long").withColumnRenamed("__fp", "fp"), "marks")
    found = marks.join(classes(marks, crowd), "fp").filter(same(F.col("id"), F.col("component_id")))
    stays = found.groupBy("id", F.when(F.col("id").isNull(), F.col("fp")).alias("__k")).agg(F.min(F.struct("fp", "h")).alias("m"))
    stays = stays.select(F.col("id").alias("__stays"), F.col("m.h").alias("__its"))
    own = wrapped(docs)
    field = lambda c, kind: F.col("__row").getField(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    own = own.withColumn("__id", field(id_col, "long")).withColumn("__h", F.xxhash64("__id", field(text_col, "string")))
    met = own.join(stays, F.col("__h") == F.col("__its")).filter(same(F.col("__id"), F.col("__stays")))
    return unwrapped(met.groupBy("__h", "__id").agg(F.first("__row").alias("__row")), docs.columns)
