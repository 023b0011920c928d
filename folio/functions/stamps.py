"""Placed signatures: turning with the page, footprint, ink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.arith import lit


def stamp_rotate(cx: Column, cy: Column, turns: Column, by: Column) -> tuple[Column, Column, Column]:
    """Centre and turns of a stamp after its page is turned ``by`` quarter turns clockwise."""
    t = F.pmod(by, F.lit(4))
    x = F.when(t == 1, 1 - cy).when(t == 2, 1 - cx).when(t == 3, cy).otherwise(cx)
    y = F.when(t == 1, cx).when(t == 2, 1 - cy).when(t == 3, 1 - cx).otherwise(cy)
    return x, y, F.pmod(turns + t, F.lit(4))


def stamp_footprint(size: Column, turns: Column, mask_w: Column, mask_h: Column, page_w: Column, page_h: Column):
    """Width and height in page pixels; the size is a share of the page's short edge."""
    w = size * F.least(page_w, page_h)
    h = w * mask_h / F.greatest(F.lit(1), mask_w)
    turned = F.pmod(turns, F.lit(2)) == 1
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def blend(under: Column, ink: Column, alpha: Column) -> Column:
    """Ink over paper in 32-bit arithmetic, truncated after adding a half."""
    f = (under.cast("float") + ((ink - under).cast("float") * alpha.cast("float")).cast("float")).cast("float")
    return F.floor((f + lit(0.5).cast("float")).cast("float")).cast("int")


def channel(color: Column, shift: int) -> Column:
    return F.shiftright(color, shift).bitwiseAND(255)


def ink_luma(color: Column) -> Column:
    return F.shiftright(channel(color, 16) * 77 + channel(color, 8) * 150 + channel(color, 0) * 29, 8)
