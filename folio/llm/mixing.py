"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, ``target / source size``.
Documents are put in order of size within their source, the expected copies are summed up
along that order, one random offset per source is added, and a document is emitted once for
each integer boundary that its part of the sum crosses. As neighbours in the order have
nearly equal sizes, the words taken differ from the target by no more than the largest
document, and nothing has to be drawn again.

Defined results: a null text has size 0; a null source is a source of its own and comes last;
repeated rows are documents of their own; a table without words has targets of 0 and takes
nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WORD, column, ranked, same, staged, wrapped

#: A source's words are used at most so often.
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): 32 bits of a hash of its name and the seed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """``(__source, __source_size)`` with the target of each source.

    Sources by code point weigh 1, 2, ..., ``cycle``, repeating. Water filling: a level times
    the weight, cut at ``most`` times the size; every round computes the level again from two
    sums over all sources, until no further source is cut.
    """
    weighed = ranked(sizes, [], ["__source"]).withColumn("__weight", ((F.col("__rank") - 1) % cycle + 1).cast("long"))
    weighed = staged(weighed.drop("__rank"), "weights")
    cap, w = F.col("__source_size") * most, F.col("__weight")
    level, cut = 0.0, -1
    while True:
        over = w * F.lit(level) > cap
        one = weighed.agg(
            F.coalesce(F.sum("__source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, w)), F.lit(0)), F.count(F.when(over, 1))).first()
        if one[3] == cut or not one[2]:
            break
        cut, level = one[3], (one[0] - one[1]) / one[2]
    share = w * F.lit(level)
    return weighed.withColumn("__target", F.when(share > cap, cap.cast("double")).otherwise(share))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: int = 1, cycle: int = 3, most: int = MOST, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    With ``carry`` the input row comes along as ``__row``. Ties in size are ordered by id;
    rows that agree in source, size and id are interchangeable in the result.
    """
    own = wrapped(docs)
    col = lambda c, kind: column(docs, c, kind) if not carry else (
        F.col("__row").getField(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind))
    base = own if carry else docs
    sized = base.select(*(["__row"] if carry else []), col(id_col, "long").alias("__id"),
                        col(source_col, "string").alias("__source"), words(col(text_col, "string")).alias("__size"))
    if not carry:
        sized = staged(sized, "sizes")
    totals = staged(sized.groupBy("__source").agg(F.sum("__size").alias("__source_size")), "totals")
    goal = targets(totals, cycle, most).select(F.col("__source").alias("__name"), "__source_size", "__target")
    rows = ranked(sized, ["__source"], ["__size", "__id"])
    rows = rows.join(goal, same(F.col("__source"), F.col("__name")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("__source"), seed)
    copies = (F.floor(start + rate * F.col("__rank")) - F.floor(start + rate * (F.col("__rank") - 1))).cast("long")
    out = rows.withColumn("__copies", F.least(copies, F.lit(most).cast("long")))
    return out.select(*(["__row"] if carry else []), F.col("__id").alias("doc_id"), F.col("__source").alias("source"),
                      F.col("__size").alias("size"), "__source_size", F.col("__target").alias("target"),
                      F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken")
                      ).withColumnRenamed("__source_size", "source_size")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it was drawn, with ``copy_no`` from 1 to its copies."""
    rows = sampled(docs, carry=True, **options).filter(F.col("copies") > 0)
    out = rows.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"))
    keep = [c for c in docs.columns if c.lower() != "copy_no"]
    return out.select(*[F.col("__row").getField(c).alias(c) for c in keep], F.col("__copy").alias("copy_no"))
