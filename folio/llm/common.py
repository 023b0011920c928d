"""What the operators share: reading tables, staging in the shared folder, ranks over any number of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.session import checkpoint_dir

#: White space as the contracts write it, and its complement, the words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/folio/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: what comes after reads committed files, so a lost executor costs
    only its own tasks. Nothing stays on executors.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(ident: str | Column, n: int) -> Column:
    """``crc32`` of the id as text modulo ``n``; a null id counts as the empty text."""
    col = F.col(ident) if isinstance(ident, str) else ident
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def same(a: Column, b: Column) -> Column:
    """Equal, or both null: joins that must not lose rows with null keys."""
    return a.eqNullSafe(b)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``; null where the table lacks it."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)


def wrapped(df: DataFrame) -> DataFrame:
    """Every column packed into ``__row``, so that no name of the input can clash with an operator's own."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def ranked(df: DataFrame, group: list[str], by: list[str], name: str = "__rank") -> DataFrame:
    """Row numbers (from 1) within ``group`` in the order ``by`` without gathering a group.

    Rows are dealt out by ranges of (group, by), so one group may span many tasks. Each row
    gets its place within its task, the sorted rows are staged, and a table with one row per
    task and group says what place the group's part in that task begins at. Ties must be
    rows that may be exchanged for each other. Nulls come last.
    """
    order = [F.col(c).asc_nulls_last() for c in [*group, *by]]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("__task", task).withColumn("__place", place).drop("__at")
    parts = rows.groupBy("__task", *group).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("__task").alias("__task2"), *[F.col(c).alias(f"__of_{c}") for c in group],
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    cond = F.col("__task") == F.col("__task2")
    for c in group:
        cond &= same(F.col(c), F.col(f"__of_{c}"))
    joined = rows.join(parts, cond, "left").withColumn(name, F.col("__place") + F.col("__shift") + 1)
    return joined.drop("__task", "__place", "__task2", "__shift", *[f"__of_{c}" for c in group])


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))


def tiles(batch, at: int, rows: int, most_bytes: int):
    """An Arrow batch in slices of at most ``rows`` rows and about ``most_bytes`` in column ``at`` (a longer value is a slice of its own)."""
    import pyarrow.compute as pc

    begin = held = 0
    for row, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if row > begin and (held + (n or 0) > most_bytes or row - begin >= rows):
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += n or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)


def best(df: DataFrame, group: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group and their ``rank`` (from 1), taken first within salted parts, so that no task meets all rows of a group."""
    place = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order))
    few = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withColumn("__place", place).filter(F.col("__place") <= k)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return few.drop("__salt", "__place").withColumn("rank", rank).filter(F.col("rank") <= k)
