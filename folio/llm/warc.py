"""WARC records in ZIP packages: written in one pass, read back by range reads without extraction.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` with
one gzip member per record, and ``indexes/index.cdxj`` with the offset and length of each. The
reader parses the end of the central directory, the ZIP64 directory where there is one, and the
entries; it finds both members through their local headers, reads the index, and then only
the byte ranges of the records.

Writing is streaming: a task holds one record and the index of one package (at most
``RECORDS``). Packages get a fresh name per attempt in the shared folder, and only those that
the staged manifest names are read, so a repeated or lost task leaves no double records.
Files are reached through the file system that the shared folder's URI names.

Records of equal payload: the one with the largest page id is the response, the others revisit
it. Payloads move once, to meet the digest's group; a payload that a third of all rows share is
a skewed join, which adaptive execution splits, and its groups are combined before the shuffle.

Defined results: null html is an empty payload; a null url is ``urn:none``; a null page id
counts as the smallest and, where no row of the payload has an id, is a response; rows that
repeat the response's id and payload are responses too; an empty table gives no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import column, same, shared_path, staged

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed at so many records or bytes.
RECORDS, PACKAGE_BYTES = 50_000, 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _header_value(text: str | None) -> str:
    """A URL that cannot break a header: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text) if text else "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = HTTP % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
             f"WARC-Target-URI: {_header_value(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    block = head if revisit else head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """One package being written."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = located(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, page_id: int | None, url: str | None, data: bytes) -> None:
        packed = gzip.compress(data, compresslevel=6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": page_id, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as f:
            f.write("".join(f"{x}\n" for x in self.index).encode())
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        done = lambda p: pa.RecordBatch.from_pylist([dict(zip(("package", "records"), p.close()))])
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for row in range(batch.num_rows):
                page_id, url, html, refers_to, revisit = (c[row].as_py() for c in columns)
                package = package or Package(folder)
                package.add(page_id, url, record(page_id, url, html, refers_to, revisit))
                if len(package.index) >= RECORDS or package.offset >= PACKAGE_BYTES:
                    yield done(package)
                    package = None
        if package:
            yield done(package)

    return run


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row of ``pages`` and return the manifest ``(package, records)``."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = pages.select(column(pages, id_col, "long").alias("page"), column(pages, url_col, "string").alias("url"),
                        F.coalesce(column(pages, html_col, "string"), F.lit("")).cast("binary").alias("html"))
    digest = F.sha1("html")
    first = rows.groupBy(digest.alias("of"), F.octet_length("html").alias("bytes")).agg(F.max("page").alias("first"))
    met = rows.withColumn("digest", digest).join(first, (F.col("digest") == F.col("of")) & (F.octet_length("html") == F.col("bytes")))
    ready = met.select("page", "url", "html", F.col("first").alias("refers_to"), (~same(F.col("page"), F.col("first"))).alias("revisit"))
    return staged(ready.mapInArrow(_writer(folder), "package string, records long"), "manifest")


# ---- reading


def _tail(f, size: int) -> tuple[bytes, int]:
    """The last bytes of a file, long enough for any end record (22 bytes and a comment of up to 65,535)."""
    at = max(0, size - 22 - 65_535 - 20)
    f.seek(at)
    return f.read(size - at), at


def central_directory(f, size: int) -> dict[str, tuple[int, int]]:
    """``name -> (offset of the data, length)`` of the stored members of a ZIP or ZIP64 file."""
    tail, base = _tail(f, size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):  # a comment may hold the signature
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: it has no end record")
    count, length, start = struct.unpack("<HII", tail[at + 10:at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if tail[at - 20:at - 16] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        f.seek(struct.unpack("<Q", tail[at - 12:at - 4])[0])
        end = f.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    f.seek(start)
    data, members, p = f.read(length), {}, 0
    for _ in range(count):
        if data[p:p + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is damaged")
        method, = struct.unpack("<H", data[p + 10:p + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[p + 20:p + 34])
        header, = struct.unpack("<I", data[p + 42:p + 46])
        name = data[p + 46:p + 46 + n_name].decode("utf-8", "replace")
        extra = data[p + 46 + n_name:p + 46 + n_name + n_extra]
        packed, plain, header = _zip64(extra, plain, packed, header)
        p += 46 + n_name + n_extra + n_comment
        if method == 0:
            members[name] = (header, packed)
    for name, (header, packed) in members.items():
        f.seek(header)
        local = f.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a local header is damaged")
        members[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
    return members


def _zip64(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset with those that the ZIP64 extra field holds instead."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[p:p + 4])
        if kind == 1:
            rest = iter(struct.unpack(f"<{n // 8}Q", extra[p + 4:p + 4 + n // 8 * 8]))
            plain, packed, header = (next(rest) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
        p += 4 + n
    return packed, plain, header


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def _page(text: str) -> int | None:
    said = text.removeprefix("<urn:page:").removesuffix(">")
    return None if said == "null" else int(said)


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a package, by range reads."""
    system, path = located(uri)
    with system.open_input_file(path) as f:
        members = central_directory(f, f.size())
        at, n = members[INDEX_MEMBER]
        f.seek(at)
        index = f.read(n).splitlines()
        start, _ = members[WARC_MEMBER]
        for line in index:
            where = json.loads(line)
            f.seek(start + where["offset"])
            yield parsed(gzip.decompress(f.read(where["length"])))


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if revisit:
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
    else:
        size = len(payload)
        if base32_sha1(payload) != said:
            raise ValueError(f"payload of {fields['warc-record-id']} doesn't have the digest it is filed under")
    return (_page(fields["warc-record-id"]), size, said, fields["warc-type"],
            _page(fields["warc-refers-to"]) if revisit else None, fields["warc-target-uri"])


#: Rows of a result batch, and tasks that read packages at most.
BATCH, TASKS = 4096, 50_000


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for fields, block in records(uri):
                rows.append(_row(fields, block))
                if len(rows) == BATCH:
                    yield make(rows)
                    rows = []
            if rows:
                yield make(rows)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each record of the packages that ``manifest`` names, in a task for each package up to ``TASKS``.

    The number is given, so adaptive execution, which sees only the few bytes of the names,
    does not merge the tasks.
    """
    packages = manifest.select("package")
    return packages.repartition(max(1, min(packages.count(), TASKS))).mapInArrow(_reader, ROW)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as the packages hold them."""
    return read(pages.sparkSession, write(pages, folder)).drop("url")
