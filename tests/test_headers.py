"""Headers of pictures that no query's table holds: fill bytes, cut chains, odd densities."""

from __future__ import annotations

import struct

import pytest

from folio.sources import files as FS
from folio.sources.headers import head

SOF = b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + bytes(10)


def jfif(unit, x, y):
    return b"\xff\xe0" + struct.pack(">H5sHBHHH", 16, b"JFIF\0", 0x102, unit, x, y, 0)


@pytest.mark.parametrize("data, want", [
    (b"\xff\xd8" + jfif(1, 300, 200) + SOF, (40, 30, 300.0, 200.0)),
    (b"\xff\xd8" + jfif(0, 1, 1) + SOF, (40, 30, 0.0, 0.0)),  # an aspect, no density
    (b"\xff\xd8\xff\xff\xff\xd0" + SOF, (40, 30, 0.0, 0.0)),
    (b"\xff\xd8\xff\xc4\x00\x04ab" + SOF, (40, 30, 0.0, 0.0)),  # a table is no frame
    (b"\xff\xd8\xff\xda\x00\x02" + SOF, None),
    (b"\xff\xd8" + jfif(1, 300, 200), None),
    (b"BM" + bytes(12) + struct.pack("<IHH", 12, 7, 9), (7, 9, 0.0, 0.0)),
    (b"BM" + bytes(12) + struct.pack("<Iii", 40, 7, -9) + bytes(12) + struct.pack("<ii", 0, 0), (7, 9, 0.0, 0.0)),
    (b"GIF87a" + struct.pack("<HH", 5, 0), None),
    (b"II*\0" + struct.pack("<IHHHII", 8, 1, 256, 3, 1, 5), None),  # no height
    (b"II*\0" + struct.pack("<I", 1 << 30), None),
    (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1 << 31, 4) + bytes(9), None),
    (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 3, 4) + bytes(9), (3, 4, 0.0, 0.0)),
    (b"", None), (b"notes", None)])
def test_heads(data, want):
    assert head(memoryview(data)) == want


def test_every_file_has_a_row(spark):
    rows = [("a", b"\xff\xd8" + jfif(1, 300, 200) + SOF), ("b", None), ("c", b""), ("a", b"\xff\xd8" + jfif(1, 300, 200) + SOF), ("d", b"GIF89a")]
    files = spark.createDataFrame([(p, c, 1) for p, c in rows], "path string, content binary, w int")
    got = sorted((r.path, r.w, r.h, r.dpi_x, r.dpi_y, r.state) for r in FS.image_info(files).collect() if r.w)
    assert got == [("a", 40, 30, 300, 200, "Ready")] * 2
    assert FS.image_info(files).filter("state = 'Failed' AND w IS NULL AND dpi_x IS NULL").count() == 3
    assert FS.image_info(files.limit(0)).count() == 0
