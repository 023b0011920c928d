"""Small numbers the image operators are driven by: factors, windows, strengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.arith import clamp, lit

# fixed values
ANALYSIS_DPI = 100
BLANK_INK_PERCENT = 0.03
SAUVOLA_K = 0.34
SMOOTH_RAMP = 12.0
UNSHARP_AMOUNT = 0.8


def analysis_factor(dpi: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(dpi / ANALYSIS_DPI)).cast("int")


def sauvola_window(dpi: Column) -> Column:
    """About an eighth of an inch, odd, 15 to 151."""
    return clamp(F.rint(dpi / 8.0).cast("int").bitwiseOR(F.lit(1)), 15, 151)


def sauvola_k(darkness: Column) -> Column:
    return F.lit(0.55) - F.lit(0.0042) * clamp(darkness, 0, 100)


def otsu_offset(darkness: Column) -> Column:
    return F.rint((clamp(darkness, 0, 100) - 50) * F.lit(0.8)).cast("int")


def sharpen_radius(dpi: Column) -> Column:
    return clamp(F.rint(dpi / 150.0).cast("int"), 1, 4)


def speckle_area(dpi: Column) -> Column:
    side = F.greatest(F.lit(1), F.floor(dpi / 100)).cast("int")
    return side * side


def luma(r, g, b) -> Column:
    """Gray of a page image, rounded."""
    return F.floor((lit(r) * 299 + lit(g) * 587 + lit(b) * 114 + 500) / 1000).cast("int")


def luma_classify(r, g, b) -> Column:
    """Gray used when telling colour pages apart, truncated."""
    return F.floor((lit(r) * 299 + lit(g) * 587 + lit(b) * 114) / 1000).cast("int")


def luma_signature(r, g, b) -> Column:
    """Cheap gray used for frame signatures and stamps."""
    return F.shiftright((lit(r) * 77 + lit(g) * 150 + lit(b) * 29).cast("int"), 8)


# plain numbers, for job parameters known on the driver

def window_for(dpi: int) -> int:
    return min(max(round(dpi / 8.0) | 1, 15), 151)


def k_for(darkness: int) -> float:
    return 0.55 - 0.0042 * min(max(darkness, 0), 100)


def radius_for(dpi: int) -> int:
    return min(max(round(dpi / 150.0), 1), 4)


def factor_for(dpi: int) -> int:
    return max(1, dpi // ANALYSIS_DPI)


def area_for(dpi: int) -> int:
    return max(1, dpi // 100) ** 2
