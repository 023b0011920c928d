"""Recognised words: text layer placement, language checks, cache look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_layer(words: DataFrame, dpi: int, page_height_pt: float) -> DataFrame:
    """Invisible text rows: position, size and stretch in points, text as UTF-16 hex; empty boxes dropped."""
    w = words.filter((F.col("w") > 0) & (F.col("h") > 0) & (F.length("text") > 0))
    size = F.greatest(F.lit(1.0), F.col("h") * 72.0 / dpi)
    units = F.length(F.encode("text", "UTF-16BE")) / 2
    natural = units * size * 0.5
    return w.withColumns({
        "tx": F.col("x") * 72.0 / dpi, "ty": F.lit(page_height_pt) - F.col("baseline_y") * 72.0 / dpi, "size": size,
        "scale": F.when(natural > 0, 100.0 * (F.col("w") * 72.0 / dpi) / natural).otherwise(100.0),
        "hex": F.hex(F.encode(F.concat("text", F.lit(" ")), "UTF-16BE"))})


def languages_available(langs: Column, installed: list[str]) -> Column:
    """Every non-empty part of ``vie+eng`` is installed."""
    parts = F.filter(F.split(langs, r"\+"), lambda p: p != "")
    return F.size(F.array_except(parts, F.array(*[F.lit(x) for x in installed]))) == 0


def ocr_todo(pages: DataFrame, cache_keys: DataFrame) -> DataFrame:
    """Ready pages whose key is not cached yet."""
    return pages.filter("state = 'Ready'").join(cache_keys.select("key").distinct(), "key", "left_anti")


def words_for(pages: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached words of a page when its key is known, otherwise the newly recognised ones."""
    known = cached.select("key").distinct()
    from_cache = pages.join(cached, "key")
    from_new = pages.join(known, "key", "left_anti").join(fresh, "page_id")
    cols = ["page_id", "text"]
    return from_cache.select(*cols, F.lit("cache").alias("origin")).unionByName(from_new.select(*cols, F.lit("new").alias("origin")))
