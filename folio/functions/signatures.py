"""Frame signatures: coarse gray pictures compared by mean absolute difference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signature_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long level arrays."""
    gaps = F.zip_with(a, b, lambda p, q: F.abs(p - q))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g) / F.size(a)
