"""Brightness and contrast as one linear map of levels, in 32-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.arith import clamp


def f32(c: Column) -> Column:
    return c.cast("float")


def brightness_levels(brightness: Column) -> Column:
    return f32(f32(clamp(brightness, -100, 100)) * f32(F.lit(1.28)))


def tone_scale(contrast: Column) -> Column:
    return f32(F.pow(F.lit(2.0), f32(f32(clamp(contrast, -100, 100)) / 70).cast("double")))


def tone_offset(brightness: Column, contrast: Column) -> Column:
    return f32(f32(f32(F.lit(128)) * f32(F.lit(1) - tone_scale(contrast))) + brightness_levels(brightness))


def tone_level(v: Column, scale: Column, offset: Column) -> Column:
    return clamp(F.rint(f32(f32(f32(v) * scale) + offset)).cast("int"), 0, 255)


def tone_lut(scale: Column, offset: Column) -> Column:
    """Output level of every input level."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: tone_level(v, scale, offset))


def color_matrix(scale: Column, offset: Column) -> Column:
    z, one = f32(F.lit(0)), f32(F.lit(1))
    s, o = scale, offset
    return F.array(s, z, z, z, o, z, s, z, z, o, z, z, s, z, o, z, z, z, one, z)


def signature_mask(v: Column, threshold: Column) -> Column:
    """Ink coverage 0..255: full at or below the threshold, a soft rim above it."""
    ramp = F.greatest(F.lit(8.0), threshold * 0.25)
    soft = clamp(1.0 - (v - threshold) / ramp, 0.0, 1.0)
    return F.when(v <= threshold, 255).otherwise(F.rint(soft * 255)).cast("int")
