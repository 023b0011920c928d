"""Files in and out: page files, pictures, catalogues, projects, words, logs, exports, renders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import naming as N
from folio.functions.geometry import resolve_dpi
from folio.functions.pages import PAGE_EXTENSIONS, PHOTO_EXTENSIONS
from folio.session import shuffle_partitions
from folio.sources.headers import heads


# --- page files and pictures -------------------------------------------------------

def supported(path: Column) -> Column:
    return N.extension(path).isin(*PAGE_EXTENSIONS)


def photo_extension(name: Column) -> Column:
    """Known photo extension, else ``.jpg``."""
    e = N.extension(name)
    return F.when(e.isin(*PHOTO_EXTENSIONS), e).otherwise(".jpg")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime, ext, content`` of supported page files; content is read only if used."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.filter(supported(F.col("path"))).withColumn("ext", N.extension(F.col("path")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id (path), w, h, y, vals``: decoded rows, gray or R, G, B interleaved, spread by picture.

    Pictures without rows are those that :func:`image_states` reports as failed."""
    d = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                a = a[:, :, 0] if r.nChannels == 1 else a[:, :, 2::-1]  # stored B, G, R
                yield pd.DataFrame({"image_id": r.origin, "w": r.width, "h": r.height, "y": range(r.height),
                                    "vals": list(a.reshape(r.height, -1).astype(np.int16))})

    return d.mapInPandas(rows, "image_id string, w int, h int, y int, vals array<smallint>").repartition(
        shuffle_partitions(spark), "image_id")


def image_states(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, w, h, state`` of every picture file: ``Ready``, or ``Failed`` (without a size) where it can't be decoded."""
    d = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ok = F.col("width") > 0
    return d.select(F.col("origin").alias("image_id"), F.when(ok, F.col("width")).alias("w"), F.when(ok, F.col("height")).alias("h"),
                    F.when(ok, "Ready").otherwise("Failed").alias("state"))


def image_info(files: DataFrame) -> DataFrame:
    """``path, w, h, dpi_x, dpi_y, state`` of PNG, JPEG, BMP, GIF and TIFF files from their headers alone.

    Files whose header can't be read (cut off, of another kind, null) stay as ``Failed`` rows without a size.
    """
    d = heads(files)
    x, y = resolve_dpi(F.col("w"), F.col("h"), F.col("tag_x"), F.col("tag_y"))
    ok = F.col("w").isNotNull()
    return d.select("path", "w", "h", F.when(ok, x).alias("dpi_x"), F.when(ok, y).alias("dpi_y"), F.when(ok, "Ready").otherwise("Failed").alias("state"))


def fan_out_frames(files: DataFrame) -> DataFrame:
    """One row per page of ``name, frames, is_pdf``: ``k`` (1..) and its label; PDFs are always numbered."""
    d = files.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("frames"))))
    return d.withColumn("label", N.label(F.col("name"), F.col("k"), F.col("frames"), F.col("is_pdf")))


# --- catalogue files ---------------------------------------------------------------

#: Every stored field of a page: name, type and the value of a missing one (fixed values); null has no default.
PAGE_FIELDS = (
    ("id", "string", None), ("state", "string", "Ready"), ("error", "string", None), ("originalExtension", "string", ".jpg"), ("rawWidth", "int", 0), ("rawHeight", "int", 0),
    ("exifOrientation", "int", 1), ("userRotation", "int", 0), ("proxyWidth", "int", 0), ("proxyHeight", "int", 0), ("cropQuad", "array<double>", None),
    ("cropConfidence", "double", 0.0), ("cropManual", "boolean", False), ("cropDetected", "boolean", False), ("cropDetection", "int", 0), ("croppedRevision", "int", 0),
    ("croppedWidth", "int", 0), ("croppedHeight", "int", 0), ("croppedQuad", "array<double>", None), ("croppedRotation", "int", 0), ("outputRotation", "int", 0),
    ("croppedOutputRotation", "int", 0), ("freeAspect", "boolean", False), ("croppedFreeAspect", "boolean", False), ("renderError", "string", None),
    ("colorMode", "string", "Color"), ("bwDarkness", "int", 50), ("cleanBackground", "boolean", True), ("brightness", "int", 0), ("contrast", "int", 0),
    ("croppedColorMode", "string", "Color"), ("croppedBwDarkness", "int", 50), ("croppedCleanBackground", "boolean", True), ("croppedBrightness", "int", 0), ("croppedContrast", "int", 0),
    ("croppedExtension", "string", ".jpg"), ("croppedGeometry", "int", 0), ("croppedBlackWhiteVersion", "int", 0), ("cropBend", "array<double>", None), ("croppedBend", "array<double>", None))
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType())}
PAGE = T.StructType([T.StructField(n, _TYPES[t]) for n, t, _ in PAGE_FIELDS])
DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("createdUtc", T.TimestampType()),
                         T.StructField("folderId", T.StringType()), T.StructField("pages", T.ArrayType(PAGE)), T.StructField("_corrupt_record", T.StringType())])
FOLDER = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("createdUtc", T.TimestampType()),
                       T.StructField("_corrupt_record", T.StringType())])
WORD = T.StructType([T.StructField(n, t) for n, t in (("Text", T.StringType()), ("X", T.IntegerType()), ("Y", T.IntegerType()), ("Width", T.IntegerType()), ("Height", T.IntegerType()),
                                                     ("BaselineY", T.IntegerType()), ("Confidence", T.FloatType()), ("_corrupt_record", T.StringType()))])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: whole text files."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def _parsed(files: DataFrame, schema: T.StructType, many: bool = True) -> DataFrame:
    """Objects of JSON files (``file, value``), or of the lists in them; files that are no such JSON are skipped."""
    kind = T.ArrayType(schema) if many else schema
    got = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = files.withColumn("_r", F.explode(got) if many else got).filter("_r IS NOT NULL AND _r._corrupt_record IS NULL")
    return d.select("file", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema if f.name != "_corrupt_record"])


def parse_catalogue(files: DataFrame) -> DataFrame:
    """Readable documents of ``file, value`` rows; those in a folder of another name than their id are skipped."""
    own = F.regexp_extract("file", r"([^/]+)/doc\.json$", 1)
    return _parsed(files, DOCUMENT, many=False).filter(F.col("id") == own).drop("file")


def read_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Readable documents, newest first; unreadable ones and folders of another name are skipped."""
    return parse_catalogue(read_texts(spark, f"{root}/*/doc.json")).orderBy(F.desc("createdUtc"))


def catalogue_pages(docs: DataFrame) -> DataFrame:
    """One row per page with the documented default of every missing field."""
    p = docs.select(F.col("id").alias("doc_id"), F.posexplode("pages").alias("pos", "p")).select("doc_id", "pos", "p.*")
    return p.withColumns({n: F.coalesce(n, F.lit(v)) for n, _, v in PAGE_FIELDS if v is not None})


def parse_folders(files: DataFrame) -> DataFrame:
    return _parsed(files, FOLDER).drop("file").filter("id IS NOT NULL")


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folder list; an unreadable file is an empty list."""
    return parse_folders(read_texts(spark, path))


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Page rows of project files (old and new form) with defaults; pages cut off mid-way are failed."""
    s = T.StructType([T.StructField(f"_{n}", t) for n, t in (("Id", T.StringType()), ("File", T.StringType()), ("PdfPage", T.IntegerType()), ("NativeDpi", T.DoubleType()), ("Label", T.StringType()),
                                                             ("State", T.StringType()), ("Error", T.StringType()), ("Rotate", T.IntegerType()), ("Deskew", T.DoubleType()), ("Crop", T.StringType()))])
    d = spark.read.format("xml").schema(s).option("rowTag", "Page").load(path)
    known = F.when(F.col("_State").isin("Ready", "Pending", "Failed"), F.col("_State")).otherwise("Ready")
    cut = known == "Pending"
    return d.select(N.blank_to_null(F.col("_Id")).alias("page_id"), F.col("_File").alias("path"), F.coalesce("_PdfPage", F.lit(-1)).alias("pdf_page"),
                    F.coalesce("_NativeDpi", F.lit(0.0)).alias("native_dpi"), F.coalesce("_Label", F.lit("")).alias("label"),
                    F.when(cut, "Failed").otherwise(known).alias("state"), F.when(cut, "interrupted").otherwise(N.blank_to_null(F.col("_Error"))).alias("error"),
                    F.coalesce("_Rotate", F.lit(0)).alias("rotate"), F.coalesce("_Deskew", F.lit(0.0)).alias("deskew"), N.parse_crop(F.col("_Crop")).alias("crop"))


def parse_ocr_words(files: DataFrame) -> DataFrame:
    """Cached word rows by ``key`` (the file name); unreadable entries are ignored."""
    d = _parsed(files.withColumn("file", N.stem(F.col("file"))), WORD)  # once a file, not once a word
    return d.select(F.col("file").alias("key"), F.col("Text").alias("text"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Width").alias("w"),
                    F.col("Height").alias("h"), F.col("BaselineY").alias("baseline_y"), F.col("Confidence").alias("confidence")).filter("text IS NOT NULL")


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_ocr_words(read_texts(spark, path))


SIGNATURE = T.StructType([T.StructField("id", T.StringType()), T.StructField("color", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
                          T.StructField("createdUtc", T.TimestampType()), T.StructField("_corrupt_record", T.StringType())])


def parse_signatures(files: DataFrame) -> DataFrame:
    return _parsed(files, SIGNATURE).drop("file").filter("id IS NOT NULL")


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of an index file, newest first."""
    return parse_signatures(read_texts(spark, path)).orderBy(F.desc("createdUtc"))


# --- logs and exports --------------------------------------------------------------

def parse_perf(lines: DataFrame) -> DataFrame:
    """``name, ms`` of timing lines (``PERF name n ms`` or ``name n ms``); other lines are left out."""
    pat = r"(?:^|\bPERF )([^\r\n]*?) (\d+) ms\s*$"
    name = F.regexp_replace(F.regexp_extract("value", pat, 1), r"^.*\bPERF ", "")
    d = lines.withColumns({"name": name, "ms": F.regexp_extract("value", pat, 2).try_cast("int")})
    return d.filter("ms IS NOT NULL AND name <> ''")


def read_perf_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_perf(spark.read.text(path)).select("name", "ms")


def list_exports(files: DataFrame) -> DataFrame:
    """Finished exports by name without extension, newest first, from file metadata only."""
    return (files.filter(F.lower("path").endswith(".pdf")).select("path", N.stem(F.col("path")).alias("name"), "length", "modificationTime")
            .orderBy(F.desc("modificationTime")))


# --- writing -----------------------------------------------------------------------

def write_catalogue(df: DataFrame, root: str, version: int) -> str:
    """All-or-nothing save: a new version folder, visible to readers only when its commit marker exists."""
    path = f"{root}/v={version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_latest_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest version that was committed whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(base) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(p.toString() for p in done))


PAGE_BUCKETS = 64  # folders of a page store; a document's rows lie together in one of them


def write_pages(scanlines: DataFrame, path: str, buckets: int = PAGE_BUCKETS) -> None:
    """Rendered rows by document, each with its ``revision``; older revisions stay until cleaned up.

    Documents are spread over a fixed number of folders by a hash of their id and sorted within files, so
    the number of files follows the bytes and not the documents.
    """
    d = scanlines.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    d = d.repartition("bucket", "doc_id", "image_id").sortWithinPartitions("bucket", "doc_id", "image_id", "y")
    d.write.mode("append").partitionBy("bucket").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest revision of each page."""
    d = spark.read.parquet(path).drop("bucket")
    newest = d.groupBy("image_id").agg(F.max("revision").alias("_r")).withColumnRenamed("image_id", "_i")
    return d.join(newest, (F.col("image_id") == F.col("_i")) & (F.col("revision") == F.col("_r"))).drop("_i", "_r")


def frame_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Frames as a stream, a few files per trigger in arrival order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
