"""Running totals and positions inside a key that may hold a large share of all rows.

A plain window sorts everything of one key in one task. Here each key is cut into chunks of
its order (a block of positions, a day); chunk totals are combined before the exchange, run
over the few chunk rows of a key, and are joined back by (key, chunk), so no task ever holds
more than one chunk of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def block(pos: Column | str, size: int = BLOCK) -> Column:
    """Chunk number of an integer position."""
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / size)


def day(ts: Column | str) -> Column:
    return F.unix_date(F.to_date(ts))


def running_sums(df: DataFrame, key: str, chunk: Column, order: list, values: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums per ``key``; ``order`` must refine ``chunk``."""
    d = df.withColumn("_chunk", chunk)
    totals = d.groupBy(key, "_chunk").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    over = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_key"), F.col("_chunk").alias("_c"),
                           *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in values])
    inner = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({n: F.sum(v).over(inner) for n, v in values.items()})
    d = d.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_c")))
    return d.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in values}).drop(
        "_chunk", "_key", "_c", *[f"_b_{n}" for n in values])


def numbered(df: DataFrame, key: str, chunk: Column, order: list, name: str = "idx") -> DataFrame:
    """Adds the 1-based position of each row inside its key."""
    return running_sums(df, key, chunk, order, {name: F.lit(1).cast("bigint")})


def neighbor(df: DataFrame, key: str, chunk: Column, order: list, row_id: str, delta: int) -> DataFrame:
    """Adds ``neighbor_id, neighbor_index`` (0-based, null at the ends) and ``page_count``.

    Positions come from ``numbered``; the neighbour is an equi-join on (key, position).
    """
    d = numbered(df, key, chunk, order, "_i")
    other = d.select(F.col(key).alias("_k"), (F.col("_i") - delta).alias("_j"), F.col(row_id).alias("neighbor_id"),
                     (F.col("_i") - 1).alias("neighbor_index"))
    size = df.groupBy(key).agg(F.count(F.lit(1)).alias("page_count"))
    return (d.join(other, (F.col(key) == F.col("_k")) & (F.col("_i") == F.col("_j")), "left").drop("_k", "_j")
            .join(size, key).withColumn("index", F.col("_i") - 1).drop("_i"))
