"""Size and density of a picture from its header: the chain of chunks, segments or directory entries is followed to its end."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INCH = 0.0254  # metres
Head = tuple[int, int, float, float]


def _png(b: memoryview) -> Head:
    w, h = struct.unpack_from(">II", b, 16)
    at, tag = 8, (0.0, 0.0)
    while at + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if kind == b"IDAT":  # the density has to come before the pixels
            break
        if kind == b"pHYs":
            x, y, unit = struct.unpack_from(">IIB", b, at + 8)
            tag = (x * INCH, y * INCH) if unit == 1 else tag
        at += 12 + size
    return w, h, *tag


def _jpeg(b: memoryview) -> Head:
    at, tag = 2, (0.0, 0.0)
    while True:
        while b[at] != 0xFF:
            at += 1
        while b[at] == 0xFF:  # any number of fill bytes
            at += 1
        code, at = b[at], at + 1
        if code == 0x01 or 0xD0 <= code <= 0xD8:  # no length follows
            continue
        size, = struct.unpack_from(">H", b, at)
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", b, at + 3)
            return w, h, *tag
        if code in (0xD9, 0xDA):
            raise ValueError("no frame before the scan")
        if code == 0xE0 and bytes(b[at + 2:at + 7]) == b"JFIF\0":
            unit, x, y = struct.unpack_from(">BHH", b, at + 9)
            scale = {1: 1.0, 2: 2.54}.get(unit, 0.0)
            tag = (x * scale, y * scale)
        at += size


def _bmp(b: memoryview) -> Head:
    size, = struct.unpack_from("<I", b, 14)
    if size == 12:
        w, h = struct.unpack_from("<HH", b, 18)
        return w, h, 0.0, 0.0
    w, h = struct.unpack_from("<ii", b, 18)
    x, y = struct.unpack_from("<ii", b, 38)
    return w, abs(h), x * INCH, y * INCH  # a negative height means rows from the top


def _gif(b: memoryview) -> Head:
    w, h = struct.unpack_from("<HH", b, 6)
    return w, h, 0.0, 0.0


def _tiff(b: memoryview) -> Head:
    end = "<" if b[0] == 0x49 else ">"
    at, = struct.unpack_from(end + "I", b, 4)
    count, = struct.unpack_from(end + "H", b, at)
    found: dict[int, float] = {}
    for k in range(count):
        entry = at + 2 + 12 * k
        tag, kind = struct.unpack_from(end + "HH", b, entry)
        if kind in (1, 3, 4):
            found[tag], = struct.unpack_from(end + {1: "B", 3: "H", 4: "I"}[kind], b, entry + 8)
        elif kind == 5:
            top, bottom = struct.unpack_from(end + "II", b, struct.unpack_from(end + "I", b, entry + 8)[0])
            found[tag] = top / bottom if bottom else 0.0
    scale = {2: 1.0, 3: 2.54}.get(found.get(296, 2), 0.0)
    return int(found[256]), int(found[257]), found.get(282, 0.0) * scale, found.get(283, 0.0) * scale


#: First bytes of each kind and what reads it.
KINDS = ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"BM", _bmp), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"II*\0", _tiff), (b"MM\0*", _tiff))


def head(data: memoryview) -> Head | None:
    """``w, h`` and the tagged dots per inch of both axes (0: none); None where the header can't be read."""
    for magic, read in KINDS:
        if bytes(data[:len(magic)]) == magic:
            try:
                found = read(data)
            except (struct.error, IndexError, KeyError, ValueError):
                return None
            return found if 0 < min(found[:2]) and max(found[:2]) < 1 << 31 else None
    return None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [head(memoryview(c.as_buffer()).cast("B")) if c.is_valid else None for c in batch.column(1)]
        cols = [pa.array([None if f is None else f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["path", "w", "h", "tag_x", "tag_y"])


def heads(files: DataFrame) -> DataFrame:
    """``path, w, h, tag_x, tag_y`` of ``path, content`` rows; nulls where a header can't be read. No pixel is decoded."""
    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(_heads, "path string, w int, h int, tag_x double, tag_y double")
