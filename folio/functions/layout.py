"""Where a page goes on its sheet, and which quality an export uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sheet sides in points; presets as key, dpi, jpeg quality, gray dpi
A4_LONG_PT = 841.89
A4_SHORT_PT = 595.276
QUALITIES = (("small", 150, 60, None), ("medium", 200, 72, 150), ("high", 300, 90, 300))
A4_LONG_IN = 11.69


def page_layout(w: Column, h: Column, free: Column) -> dict[str, Column]:
    """Sheet size in points and, unless the picture fills it, the centred picture rectangle."""
    w, h = F.greatest(F.lit(1), w), F.greatest(F.lit(1), h)
    k = F.lit(A4_LONG_PT) / F.greatest(w, h)
    wide = w > h
    pw = F.when(wide, A4_LONG_PT).otherwise(A4_SHORT_PT)
    ph = F.when(wide, A4_SHORT_PT).otherwise(A4_LONG_PT)
    fit = F.least(pw / w, ph / h)
    iw, ih = w * fit, h * fit
    bare = free | ((F.abs(iw - pw) < 1) & (F.abs(ih - ph) < 1))
    rect = {"ix": (pw - iw) / 2, "iy": (ph - ih) / 2, "iw": iw, "ih": ih}
    return {"sheet_w": F.when(free, w * k).otherwise(pw), "sheet_h": F.when(free, h * k).otherwise(ph),
            **{n: F.when(~bare, c) for n, c in rect.items()}}


def quality_for(key: Column) -> Column:
    """Preset of a key as a struct; unknown or missing keys give the medium one."""
    def preset(q):
        edge = lambda dpi: F.lit(None if dpi is None else round(A4_LONG_IN * dpi)).cast("int")
        return F.struct(F.lit(q[0]).alias("key"), F.lit(q[1]).alias("dpi"), F.lit(q[2]).alias("jpeg_quality"),
                        F.lit(q[3]).cast("int").alias("gray_dpi"), edge(q[1]).alias("long_edge"), edge(q[3]).alias("gray_long_edge"))

    return (F.when(key == "small", preset(QUALITIES[0])).when(key == "high", preset(QUALITIES[2]))
            .otherwise(preset(QUALITIES[1])))
