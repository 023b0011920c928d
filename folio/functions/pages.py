"""Rules on page records: what is stale, exportable, equal-looking, due next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.arith import clamp

# fixed values
DETECTION_VERSION = 2
GEOMETRY_VERSION = 5
BLACK_WHITE_VERSION = 2
FREE_EXPORT_LIMIT = 5
EXPORTS_PER_INTERSTITIAL = 5
PAGE_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".jpe", ".png", ".bmp", ".tif", ".tiff", ".gif")
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".bmp", ".gif")
RAW_JPEG = (".jpg", ".jpeg", ".jpe")


def _visible_look(look: Column) -> Column:
    """A look without the settings its mode ignores, so that equal pictures have equal values."""
    mode = look["mode"]
    matters = {"darkness": mode == "BlackWhite", "clean": mode != "Color", "brightness": F.lit(True), "contrast": mode != "BlackWhite"}
    return F.struct(mode.alias("mode"), *[F.when(used, look[name]).alias(name) for name, used in matters.items()])


def same_look(a: Column, b: Column) -> Column:
    """Two looks (structs mode, darkness, clean, brightness, contrast) that give the same picture."""
    return _visible_look(a).eqNullSafe(_visible_look(b))


def needs_detection(quad: Column, manual: Column, version: Column) -> Column:
    return quad.isNull() | (~manual & (version < DETECTION_VERSION))


def no_bends(b: Column) -> Column:
    return b.isNull() | F.forall(b, lambda v: v == 0)


# What the picture of a page depends on besides its look: name -> normal form of the value.
_GEOMETRY = {"rotation": lambda v: v, "turn": lambda v: v, "free": lambda v: v, "quad": lambda v: v, "bend": lambda v: F.when(~no_bends(v), v)}
_STAMPS = {"stamps": lambda v: F.when(F.size(v) > 0, v)}


def _inputs(p, fields: dict, prefix: str = "") -> Column:
    """The inputs of a picture as one comparable struct: as wished, or (``r_``) as the render was made with."""
    values = {name: p[f"{prefix}{name}"] for name in fields}
    if "quad" in values:  # without an outline the page takes whatever the render used
        values["quad"] = F.when(p["quad"].isNotNull(), values["quad"])
    return F.struct(*[form(values[name]).alias(name) for name, form in fields.items()])


def _made_with(p, fields: dict) -> Column:
    return _inputs(p, fields).eqNullSafe(_inputs(p, fields, "r_"))


def render_is_outdated(p) -> Column:
    """Made by an older version of the geometry or of the black-and-white filter."""
    oldest = F.when(p["r_look"]["mode"] == "BlackWhite", F.least(p["geometry"] - GEOMETRY_VERSION, p["bw_version"] - BLACK_WHITE_VERSION))
    return (p["revision"] > 0) & (F.coalesce(oldest, p["geometry"] - GEOMETRY_VERSION) < 0)


def needs_render(p) -> Column:
    """No current render, or one that was made with other inputs than the page now wishes."""
    current = (p["revision"] != 0) & ~render_is_outdated(p)
    return ~(current & _made_with(p, _GEOMETRY | _STAMPS) & same_look(p["look"], p["r_look"]))


def has_plain_color_render(p) -> Column:
    """A current colour render of the page's own geometry with nothing added to it."""
    look = p["r_look"]
    plain = F.struct(look["mode"], look["brightness"], look["contrast"]).eqNullSafe(F.struct(F.lit("Color"), F.lit(0), F.lit(0)))
    bare = _STAMPS["stamps"](p["r_stamps"]).isNull() & p["quad"].isNotNull()
    return (p["revision"] > 0) & ~render_is_outdated(p) & _made_with(p, _GEOMETRY) & plain & bare


def is_raw_jpeg(is_pdf: Column, identity: Column, ext: Column) -> Column:
    return ~is_pdf & identity & ext.isin(*RAW_JPEG)


def export_codec(kind: Column, raw_jpeg: Column, pass_through: Column) -> Column:
    """What the exporter stores for a page: a 1-bit picture, the file's own bytes, or a fresh JPEG."""
    return (F.when(kind == "Bitonal", "bitonal").when(raw_jpeg & pass_through, "original")
            .when(kind == "Gray", "gray-jpeg").otherwise("color-jpeg"))


def decide_kind(mode: Column, detected: Column) -> Column:
    return F.when(mode == "BlackAndWhite", "Bitonal").when(mode.isin("Gray", "Color"), mode).otherwise(detected)


def exports_remaining(used: Column) -> Column:
    return F.greatest(F.lit(0), FREE_EXPORT_LIMIT - F.greatest(F.lit(0), used))


def can_export(is_pro: Column, used: Column) -> Column:
    return is_pro | (exports_remaining(used) > 0)


def normalize_settings(s: dict[str, Column]) -> dict[str, Column]:
    """Out-of-range values back into range, blank texts to their defaults."""
    from folio.functions.naming import blank_to_null
    limits = {"thumbnail_size": (60, 300), "max_undo": (1, 500), "jpeg_quality": (1, 100), "sauvola_k": (0.05, 1.0), "blank_percent": (0.0, 5.0)}
    defaults = {"ocr_languages": "vie+eng", "name_pattern": "Scan_{date}_{time}_{counter}"}
    out = {k: clamp(c, *limits[k]) for k, c in s.items() if k in limits}
    out |= {k: F.when(blank_to_null(c).isNull(), defaults[k]).otherwise(c) for k, c in s.items() if k in defaults}
    return out
