"""Names: patterns, file-system-safe names, accent-free search, keys and stable text forms."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions.arith import lit

# fixed values
DEFAULT_NAME = "Scan"
DEFAULT_FILE = "Tai lieu"
MAX_FILE_NAME = 80
ILLEGAL = r'[\x00-\x1f"<>|:*?\\/]'
CONTROL_OR_ILLEGAL = r'[\x00-\x1f\x7f-\x9f"<>|:*?\\/]'
TIME_TOKENS = {"date": "yyyyMMdd", "time": "HHmmss", "yyyy": "yyyy", "dd": "dd", "hh": "HH", "ss": "ss"}
SPACE = " \t\n\x0b\x0c\r\x85\xa0"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")


def blank_to_null(c: Column) -> Column:
    t = trim_space(c)
    return F.when(t != "", t)


def sanitize_name(c: Column) -> Column:
    """Illegal characters become '_'; trimmed, no trailing dots; empty names get the default."""
    s = F.regexp_replace(trim_space(F.regexp_replace(c, ILLEGAL, "_")), r"\.+$", "")
    return F.when(s == "", DEFAULT_NAME).otherwise(s)


def document_file_name(c: Column) -> Column:
    """File name of a document: '-' for illegal and control characters, at most 80, with extension."""
    s = F.regexp_replace(trim_space(F.regexp_replace(c, CONTROL_OR_ILLEGAL, "-")), r"^\.+|\.+$", "")
    s = F.when(F.length(s) > MAX_FILE_NAME, trim_space(F.substring(s, 1, MAX_FILE_NAME))).otherwise(s)
    return F.concat(F.when(s == "", DEFAULT_FILE).otherwise(s), F.lit(".pdf"))


def _pieces(pattern: str) -> list[tuple[str, str | None]]:
    """``(text, None)`` for plain text and ``(name, format)`` for each ``{name}`` or ``{name:format}``, in order."""
    out, rest = [], pattern
    while rest:
        text, opened, tail = rest.partition("{")
        inner, closed, after = tail.partition("}")
        name, _, fmt = inner.partition(":")
        if opened and closed and name and all(c == "_" or c.isalnum() for c in name):
            out += [(text, None), (name, fmt)]
            rest = after
        else:
            out.append((text + opened, None))
            rest = tail
    return out


def _stamp_time(ts: Column, default: str, free: bool):
    return lambda fmt: F.date_format(ts, fmt if fmt and free else default)


def _padded(counter: Column):
    digits = counter.cast("string")
    return lambda fmt: F.lpad(digits, F.greatest(F.lit(len(fmt or "000")), F.length(digits)), F.lit("0"))


def build_name(pattern: str, ts: Column, counter: Column, barcode: Column | None = None, profile: Column | None = None) -> Column:
    """Name from a pattern known to the job, e.g. ``Scan_{date}_{counter:0000}``; unknown tokens stay."""
    known = {name: _stamp_time(ts, default, name in ("date", "time")) for name, default in TIME_TOKENS.items()}
    known["counter"] = _padded(counter)
    for name, value in (("barcode", barcode), ("profile", profile)):
        known[name] = lambda fmt, v=value: F.lit("") if v is None else F.coalesce(v, F.lit(""))
    parts = []
    for name, fmt in _pieces(pattern):
        if fmt is None:
            parts.append(F.lit(name))
        elif name.lower() == "mm":  # months and minutes differ by case only
            parts.append(F.date_format(ts, "MM" if name == "MM" else "mm"))
        elif name.lower() in known:
            parts.append(known[name.lower()](fmt))
        else:
            parts.append(F.lit("{" + name + (f":{fmt}" if fmt else "") + "}"))
    return sanitize_name(F.concat(*parts))


def _fold_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    src, dst = [], []
    for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for cp in range(a, b):
            base = [c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn"]
            if len(base) == 1 and base[0] != chr(cp):
                src.append(chr(cp))
                dst.append(base[0])
    return "".join(src), "".join(dst)


def fold(c: Column) -> Column:
    """Lower case without accents, d-bar as d: what search compares."""
    src, dst = _fold_pairs()
    plain = F.regexp_replace(F.translate(c, src, dst), r"\p{Mn}", "")
    return F.translate(F.lower(plain), "đ", "d")


def fold_text(s: str) -> str:
    """The same fold for a query typed into the job."""
    plain = "".join(ch for ch in unicodedata.normalize("NFD", s) if unicodedata.category(ch) != "Mn")
    return plain.lower().replace("đ", "d")


def search(name: Column, query: str | None) -> Column:
    """Every folded word of the query somewhere in the folded name; a blank query matches all."""
    words = [w for w in fold_text(query or "").split(" ") if w.strip()] if (query or "").strip() else []
    folded = fold(name)
    return reduce(lambda a, b: a & b, [F.contains(folded, F.lit(w)) for w in words], F.lit(True))


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9]+$"), F.lit(False))


def _composed(s: pa.Array) -> pa.Array:
    """Each different word of a batch is composed once (Arrow's own ``utf8_normalize`` leaves accents apart)."""
    words = s.cast(pa.string()).dictionary_encode()
    composed = pa.array([unicodedata.normalize("NFC", w) for w in words.dictionary.to_pylist()], pa.string())
    return composed.take(words.indices)


_compose = F.arrow_udf(_composed, returnType=StringType())


def ocr_text_clean(c: Column) -> Column:
    """Trimmed, composed (NFC) word; null when nothing is left."""
    return F.nullif(_compose(trim_space(c)), F.lit(""))


def short_number(c: Column, places: int) -> Column:
    """At most ``places`` decimals, no trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{places}f", c + F.lit(0.0)), r"\.?0+$", "")


def ops_signature(rotate: Column, deskew: Column, crop: Column) -> Column:
    return F.concat(F.lit("r"), (rotate % 360).cast("string"), F.lit("|d"), short_number(deskew, 3), F.lit("|c"), format_crop(crop))


def format_crop(crop: Column) -> Column:
    """Crop fractions as text; empty without a crop."""
    return F.coalesce(F.concat_ws(",", *[F.when(crop.isNotNull(), short_number(crop[i], 5)) for i in range(4)]), F.lit(""))


def parse_crop(text: Column) -> Column:
    """Four numbers or null."""
    parts = F.transform(F.split(text, ","), lambda s: s.try_cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull()), parts)


def ops_is_identity(rotate: Column, deskew: Column, crop: Column) -> Column:
    return (rotate % 360 == 0) & (deskew == 0) & crop.isNull()


def rotated_by(rotate: Column, degrees: Column) -> Column:
    return F.pmod(rotate + degrees, F.lit(360))


def source_stamp(path: Column, pdf_page: Column, length: Column, modified: Column) -> Column:
    return F.concat_ws("|", F.lower(path), pdf_page.cast("string"), length.cast("string"), modified.cast("string"))


def cache_key(parts: list[Column], size: int = 24) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, size)


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def label(name: Column, k: Column, frames: Column, is_pdf: Column) -> Column:
    return F.when(is_pdf | (frames > 1), F.concat(name, lit(" #"), k.cast("string"))).otherwise(name)
