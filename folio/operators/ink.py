"""Drawn signatures: ink boxes, rasterised strokes, stamps with their ink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.arith import clamp
from folio.operators import scanlines as SL
from folio.session import shuffle_partitions


def ink_boxes(points: DataFrame, pen: float, max_edge: int) -> DataFrame:
    """``signature_id, x0, y0, x1, y1, points, scale, w, h``: bounds with room for the pen, and the mask size."""
    b = points.groupBy("signature_id").agg((F.min("x") - pen).alias("x0"), (F.min("y") - pen).alias("y0"), (F.max("x") + pen).alias("x1"), (F.max("y") + pen).alias("y1"),
                                           F.count(F.lit(1)).alias("points"))
    s = F.least(F.lit(float(max_edge)) / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(4.0))
    b = b.withColumn("scale", s)
    return b.withColumns({"w": F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) * F.col("scale")).cast("int")),
                          "h": F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) * F.col("scale")).cast("int"))})


def rasterize(points: DataFrame, pen: float, max_edge: int) -> DataFrame:
    """``signature_id, w, h, y, x, v``: coverage of round-capped pen segments, darkest wins.

    A segment expands only into the pixels of its own bounding box; equal segments are drawn once.
    """
    w = Window.partitionBy("signature_id", "stroke").orderBy("k")
    d = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "first": F.row_number().over(w) == 1})
    d = d.filter(F.col("nx").isNotNull() | F.col("first"))
    d = d.withColumns({"nx": F.coalesce("nx", "x"), "ny": F.coalesce("ny", "y")}).select("signature_id", "x", "y", "nx", "ny").distinct()
    d = d.join(ink_boxes(points, pen, max_edge).select("signature_id", "x0", "y0", "scale", "w", "h").hint("merge"), "signature_id")
    d = d.select("signature_id", "w", "h", *[((F.col(c) - F.col(o)) * F.col("scale")).alias(n) for c, o, n in (("x", "x0", "ax"), ("y", "y0", "ay"), ("nx", "x0", "bx"), ("ny", "y0", "by"))],
                 (F.lit(pen) * F.col("scale") / 2).alias("r"))
    reach = F.col("r") + 1
    span = lambda a, b, size: F.sequence(F.greatest(F.lit(0), F.floor(F.least(a, b) - F.col("r") - 1)), F.least(F.col(size) - 1, F.ceil(F.greatest(a, b) + reach)))
    d = d.withColumn("y", F.explode(span("ay", "by", "h"))).withColumn("x", F.explode(span("ax", "bx", "w")))
    dx, dy, px, py = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") + 0.5 - F.col("ax"), F.col("y") + 0.5 - F.col("ay")
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(clamp((px * dx + py * dy) / F.when(n != 0, n), 0.0, 1.0))
    d = d.withColumns({"px": px, "py": py, "dx": dx, "dy": dy, "t": t})
    ex, ey = F.col("px") - F.col("t") * F.col("dx"), F.col("py") - F.col("t") * F.col("dy")
    cover = clamp(F.col("r") + 0.5 - F.sqrt(ex * ex + ey * ey), 0.0, 1.0)
    d = d.withColumn("c", cover).filter("c > 0")
    return d.groupBy("signature_id", "w", "h", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max(F.rint(F.col("c") * 255).cast("int")).alias("v"))


CHUNK = 4096   # pen segments of a stroke that travel as one row
SPREAD = 1 << 18  # points from which on a signature is drawn in several parts
AT_ONCE = 150  # segments drawn together: what is held for them stays in the processor's cache
SLACK = 1e-6   # candidates of a scanline reach this much further than the pen


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every whole number from ``first`` to ``last`` of each row: the row and the number."""
    n = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _draw(mask: np.ndarray, seg: np.ndarray, r: float) -> None:
    """Draws pen segments (``ax, ay, bx, by``) into ``mask`` (``h, w``): 0 where no pen was, else coverage + 1, darkest wins.

    A segment is read along scanlines, only where its part near the scanline is near; the coverage is that of :func:`rasterize`.
    """
    h, w = mask.shape
    ax, ay, bx, by = seg.T
    dx, dy, reach = bx - ax, by - ay, r + 0.5 + SLACK
    s, y = _runs(np.maximum(0, np.floor(np.minimum(ay, by) - r - 1)).astype(np.int64), np.minimum(h - 1, np.ceil(np.maximum(ay, by) + r + 1)).astype(np.int64))
    # the part of the segment whose height is within reach of the scanline
    gap, rise = y + 0.5 - ay[s], dy[s]
    flat = np.abs(rise) < 1e-9
    slope = np.where(flat, 1.0, rise)
    t0, t1 = np.where(flat, 0.0, (gap - reach) / slope), np.where(flat, 1.0, (gap + reach) / slope)
    t0, t1 = np.maximum(np.minimum(t0, t1), 0.0), np.minimum(np.maximum(t0, t1), 1.0)
    near = np.where(flat, np.abs(gap) <= reach + 1e-9, t0 <= t1 + 1e-9)
    s, y, t0, t1 = s[near], y[near], t0[near], t1[near]
    x0, x1 = ax[s] + t0 * dx[s], ax[s] + t1 * dx[s]
    i, x = _runs(np.maximum(0, np.floor(np.minimum(x0, x1) - reach - 0.5)).astype(np.int64), np.minimum(w - 1, np.ceil(np.maximum(x0, x1) + reach - 0.5)).astype(np.int64))
    s, y = s[i], y[i]
    dx, dy, px, py = dx[s], dy[s], x + 0.5 - ax[s], y + 0.5 - ay[s]
    n = dx * dx + dy * dy
    t = np.where(n == 0, 0.0, np.clip((px * dx + py * dy) / np.where(n == 0, 1.0, n), 0.0, 1.0))
    ex, ey = px - t * dx, py - t * dy
    c = np.clip(r + 0.5 - np.sqrt(ex * ex + ey * ey), 0.0, 1.0)
    on = c > 0
    np.maximum.at(mask.reshape(-1), y[on] * w + x[on], np.rint(c[on] * 255).astype(np.uint16) + 1)


def raster_masks(points: DataFrame, pen: float, max_edge: int) -> DataFrame:
    """:func:`rasterize` with a row per signature: ``signature_id, w, h, mask``, two bytes a pixel, 0 where no pen was, else coverage + 1.

    Segments travel in chunks of a stroke; a task holds one mask and draws the rows of its signatures into it
    one by one. A signature of many points is drawn in parts, whose masks, at most one a task, are laid over each other.
    """
    w = Window.partitionBy("signature_id", "stroke").orderBy("k")
    d = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "_k": F.row_number().over(w)}).filter("nx IS NOT NULL OR _k = 1")
    d = d.withColumns({"nx": F.coalesce("nx", "x"), "ny": F.coalesce("ny", "y"), "_c": F.floor(F.col("_k") / CHUNK)})
    d = d.groupBy("signature_id", "stroke", "_c").agg(F.collect_list(F.array("x", "y", "nx", "ny")).alias("seg"))
    box = ink_boxes(points, pen, max_edge).select("signature_id", "x0", "y0", "scale", "w", "h", F.ceil(F.col("points") / SPREAD).alias("_n"))
    # points come out of texts, so by the size of the files the optimizer takes their segments for a table to broadcast
    d = d.join(box.hint("merge"), "signature_id").withColumn("_p", F.pmod(F.hash("stroke", "_c"), F.col("_n")))
    # drawing costs much more than its few bytes tell, so the number of tasks is given
    d = d.repartition(shuffle_partitions(points.sparkSession), "signature_id", "_p").sortWithinPartitions("signature_id")
    d = d.select("signature_id", "x0", "y0", "scale", "w", "h", "seg")
    schema = T.StructType([d.schema["signature_id"], T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("mask", T.BinaryType())])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = mask = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([mask.shape[1]], pa.int32()), pa.array([mask.shape[0]], pa.int32()),
                                                  pa.array([mask.tobytes()], pa.binary())], names=["signature_id", "w", "h", "mask"])
        for b in batches:
            sig, x0, y0, scale, ws, hs = (b.column(i).to_pylist() for i in range(6))
            for i, seg in enumerate(b.column(6)):
                if mask is None or sig[i] != key:
                    if mask is not None:
                        yield row()
                    key, mask = sig[i], np.zeros((hs[i], ws[i]), np.uint16)
                p = seg.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 4)
                p = p[~np.isnan(p).any(1)]
                p = (p - np.array([x0[i], y0[i]] * 2)) * scale[i]
                for at in range(0, len(p), AT_ONCE):
                    _draw(mask, p[at:at + AT_ONCE], pen * scale[i] / 2)
        if mask is not None:
            yield row()

    def darkest(masks: pa.Array) -> bytes:
        out = np.frombuffer(masks[0].as_buffer(), np.uint16).copy()
        for m in masks:
            np.maximum(out, np.frombuffer(m.as_buffer(), np.uint16), out=out)
        return out.tobytes()

    darkest.__annotations__ = {"masks": pa.Array, "return": bytes}
    return d.mapInArrow(drawn, schema).groupBy("signature_id", "w", "h").agg(F.arrow_udf(darkest, "binary")("mask").alias("mask"))


def _mask_digest(m: np.ndarray, w: int) -> dict:
    """As ``scanlines.digest``, over the pixels where a pen was."""
    at = np.flatnonzero(m)
    v = m[at].astype(np.int64) - 1
    return {"n": len(at), "total": int(v.sum()), "placed": int((v * ((at // w * 131 + at % w * 17) % 1009)).sum())}


mask_digest_of = SL.per_row(lambda m, w: _mask_digest(np.frombuffer(m, np.uint16), w), SL.record(n=T.LongType(), total=T.LongType(), placed=T.LongType()))


def stamps_with_ink(pages: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row per placed signature that still exists; missing ones draw nothing."""
    d = pages.withColumn("stamp", F.explode("stamps"))
    s = signatures.withColumnRenamed("signature_id", "_s")
    return d.join(s, F.col("stamp.signature_id") == F.col("_s")).drop("_s", "stamps")
