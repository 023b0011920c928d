"""Pages as one row each: ``image_id, w, h, vals`` with the levels of all scanlines as bytes.

A page is bounded (a few megabytes), so per-page work needs no exchange and no row per pixel:
small array functions run on Arrow batches of pages (batches are bounded by bytes), and the
rules on what they return are ordinary column expressions on the same row. Sliding sums come
from a summed-area table, so their cost does not grow with the window. Pixels become rows only
where a result is sparse. Colour pages hold three bytes a pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folio.functions import settings as S
from folio.operators.raster import R_SAUVOLA

BYTES = T.BinaryType()
LONGS, DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def page(vals: pa.Scalar, w: int, h: int, planes: int = 1) -> np.ndarray:
    shape = (h, w) if planes == 1 else (h, w, planes)
    return np.frombuffer(vals.as_buffer(), np.uint8).reshape(shape) if h and w else np.zeros(shape, np.uint8)


def _kept(r, kind: pa.DataType):
    """A kernel's result in the width it leaves with: a batch never holds eight bytes for a pixel that is sent as one."""
    if r is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _kept(r[f.name], f.type) for f in kind}
    if pa.types.is_list(kind) and not pa.types.is_nested(kind.value_type):
        return np.asarray(r, kind.value_type.to_pandas_dtype())
    return r.astype(np.uint8, copy=False).tobytes() if pa.types.is_binary(kind) else r


def _assembled(rows: list, kind: pa.DataType) -> pa.Array:
    """Kernel results as an Arrow array; lists are joined as whole numpy arrays."""
    if pa.types.is_struct(kind):
        parts = [_assembled([None if r is None else r[f.name] for r in rows], f.type) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([r is None for r in rows]))
    if pa.types.is_list(kind) and not pa.types.is_nested(kind.value_type):
        parts = [np.zeros(0, kind.value_type.to_pandas_dtype()) if r is None else r for r in rows]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, kind.value_type.to_pandas_dtype())])), type=kind,
                                        mask=pa.array([r is None for r in rows]))
    return pa.array(rows, kind)


def per_page(kernel: Callable, kind: T.DataType, planes: int = 1) -> Callable[..., Column]:
    """A column function ``(vals, w, h, *more)`` that gives ``kernel(page, *more)`` for each page; null for a null page."""
    arrow = to_arrow_type(kind)

    def run(vals: pa.Array, args: pa.Array) -> pa.Array:
        out = []
        for v, a in zip(vals, args.to_pylist()):
            w, h, *more = a.values()
            out.append(_kept(kernel(page(v, w, h, planes), *more), arrow) if v.is_valid else None)
        return _assembled(out, arrow)

    def call(vals: Column, w: Column, h: Column, *more: Column) -> Column:
        return F.arrow_udf(run, returnType=kind)(vals, F.struct(w.alias("w"), h.alias("h"), *[m.alias(f"a{i}") for i, m in enumerate(more)]))

    return call


def per_row(kernel: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A column function that gives ``kernel(*values)`` for each row of narrow columns; null where the first is null."""
    arrow = to_arrow_type(kind)

    def run(args: pa.Array) -> pa.Array:
        rows = [list(a.values()) for a in args.to_pylist()]
        return pa.array([None if r[0] is None else kernel(*r) for r in rows], arrow)

    return lambda *cols: F.arrow_udf(run, returnType=kind)(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)]))


SENT = 16 << 20  # bytes of results after which a task sends what it has


def _weight(r) -> int:
    return sum(map(_weight, r.values())) if isinstance(r, dict) else len(r) if isinstance(r, bytes) else getattr(r, "nbytes", 8)


def added(d: DataFrame, kernel: Callable, fields: T.StructType, args: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) and ``fields``, what ``kernel`` gives for the Arrow scalars of ``args`` in each row; nulls where it gives None.

    For results much wider than their rows: an ``arrow_udf`` has to hold all of a batch, here what is
    done leaves whenever it comes to ``SENT`` bytes. Steps on the same page are best one kernel: each
    Python function of a chain has its own worker beside every task, and its own batch of pages.
    """
    kinds, keep = to_arrow_type(fields), d.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, kept, rows, held = [b.column(c) for c in args], b.select(keep), [], 0
            for i in range(b.num_rows):
                r = kernel(*[c[i] for c in columns])
                rows.append(_kept(r, kinds))
                held += _weight(rows[-1]) if r is not None else 0
                if held >= SENT or i + 1 == b.num_rows:
                    more = [_assembled([None if x is None else x[f.name] for x in rows], f.type) for f in kinds]
                    yield pa.RecordBatch.from_arrays([*kept.slice(i + 1 - len(rows), len(rows)).columns, *more], names=[*keep, *fields.names])
                    rows, held = [], 0

    return d.mapInArrow(run, T.StructType([*[d.schema[c] for c in keep], *fields.fields]))


def of(f: Callable[..., Column], *more, vals: str = "vals", w: str | Column = "w", h: str | Column = "h") -> Column:
    """``f`` on the page columns, plain numbers as literals."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return f(F.col(vals), col(w), col(h), *[m if isinstance(m, Column) else F.lit(m) for m in more])


levels_of = per_page(lambda p: p.ravel(), T.ArrayType(T.IntegerType()))


def pixels(pages: DataFrame) -> DataFrame:
    """``image_id, w, h, y, x, v``: one row per pixel, for operators that work on rows."""
    d = pages.filter("h > 0").select("image_id", "w", "h", F.posexplode(of(levels_of)).alias("i", "v"))
    return d.select("image_id", "w", "h", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


# --- counts ------------------------------------------------------------------------

def _histogram(p: np.ndarray) -> np.ndarray:
    return np.bincount(p.ravel(), minlength=256)


histogram_of = per_page(_histogram, LONGS)


def histogram(pages: DataFrame) -> DataFrame:
    """``image_id, v, n`` of the levels that occur."""
    d = pages.filter("h > 0").select("image_id", F.posexplode(of(histogram_of)).alias("v", "n"))
    return d.filter("n > 0")


def _percentile(p: np.ndarray, share: float) -> int:
    """First level whose running count reaches ``floor(pixels * share)``; 0 when that is 0, else 255 if never."""
    target = int(np.floor(p.size * share))
    return int(np.searchsorted(np.cumsum(_histogram(p)), target)) if target else 0


percentile_of = per_page(_percentile, T.IntegerType())


# --- shrinking and windows ---------------------------------------------------------

def _shrunk(p: np.ndarray, f: int) -> np.ndarray:
    """Box mean by ``f``; what does not fill a box is left out."""
    if f <= 1:
        return p
    h, w = p.shape[0] // f, p.shape[1] // f
    return (p[:h * f, :w * f].reshape(h, f, w, f, *p.shape[2:]).sum((1, 3), dtype=np.int64) // (f * f)).astype(np.uint8)


shrunk_of = per_page(_shrunk, BYTES)


def shrink(pages: DataFrame, f: int) -> DataFrame:
    if f <= 1:
        return pages
    small = pages.withColumn("vals", of(shrunk_of, f))
    return small.withColumns({c: F.floor(F.col(c) / f).cast("int") for c in "wh"})


def _window_sums(a: np.ndarray, half: int) -> np.ndarray:
    """Sums over the clipped square around each pixel, from four look-ups in the summed-area table."""
    h, w = a.shape
    t = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(a, 0, dtype=np.int64), 1, out=t[1:, 1:])
    y, x = np.arange(h), np.arange(w)
    y0, y1, x0, x1 = np.maximum(y - half, 0), np.minimum(y + half, h - 1) + 1, np.maximum(x - half, 0), np.minimum(x + half, w - 1) + 1
    rows = t[y1] - t[y0]
    return rows[:, x1] - rows[:, x0]


def _stats(p: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    half = max(0, window // 2)
    v = p.astype(np.int64)
    n = _window_sums(np.ones_like(v), half)
    mean = _window_sums(v, half) / n
    return mean, np.maximum(0.0, _window_sums(v * v, half) / n - mean * mean)


def local_stats(pages: DataFrame, window: int) -> DataFrame:
    """Adds ``mean, variance`` of the clipped square around each pixel, as arrays in scanline order: sixteen bytes a pixel."""
    def kernel(vals: pa.Scalar, w: pa.Scalar, h: pa.Scalar) -> dict | None:
        if vals.is_valid:
            return dict(zip(("mean", "variance"), (a.ravel() for a in _stats(page(vals, w.as_py(), h.as_py()), window))))

    return added(pages, kernel, record(mean=DOUBLES, variance=DOUBLES), ["vals", "w", "h"])


def _threshold(mean: np.ndarray, variance: np.ndarray, k: float, offset: float) -> np.ndarray:
    return (mean + offset) * (1.0 + k * (np.sqrt(variance) / R_SAUVOLA - 1)) - offset


def sauvola(pages: DataFrame, window: int, k: float = S.SAUVOLA_K, offset: float = 0.0, ramp: float = 0.0) -> DataFrame:
    """Adaptive threshold: levels become ink (0) or paper (255), or a soft edge of ``ramp`` levels."""
    def kernel(p):
        t = _threshold(*_stats(p, window), k, offset)
        if ramp <= 0:
            return np.where(p <= t, 0, 255)
        return np.floor(np.clip(127.5 + (p - t) * (127.5 / ramp), 0, 255))

    return pages.withColumn("vals", of(per_page(kernel, BYTES)))


def look_grid(pages: DataFrame, window: int, settings: list[tuple[int, int]]) -> DataFrame:
    """``image_id, darkness, brightness, n, ink`` for a list of settings over one set of local statistics."""
    def kernel(p):
        mean, variance = _stats(p, window)
        return [int((p <= _threshold(mean, variance, S.k_for(d), b * 1.28)).sum()) for d, b in settings]

    rows = pages.filter("h > 0").select("image_id", (F.col("w") * F.col("h")).cast("bigint").alias("n"), F.posexplode(of(per_page(kernel, LONGS))).alias("i", "ink"))
    pick = lambda k: F.array(*[F.lit(s[k]) for s in settings])[F.col("i")]
    return rows.select("image_id", "n", pick(0).alias("darkness"), pick(1).alias("brightness"), "ink")


# --- even lighting and sharpening --------------------------------------------------

ESTIMATE_EDGE = 256  # longest side of the copy on which the paper's brightness is estimated


def _axis_sums(a: np.ndarray, r: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Clipped sliding sums along one axis, and how many cells each has."""
    n = a.shape[axis]
    run = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)], axis)
    low, high = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r, n - 1) + 1
    count = (high - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
    return np.take(run, high, axis) - np.take(run, low, axis), count


def _largest(a: np.ndarray, r: int) -> np.ndarray:
    """Square maximum of radius ``r``."""
    for axis in (0, 1):
        pad = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = np.maximum.reduce([np.take(pad, np.arange(i, i + a.shape[axis]), axis) for i in range(2 * r + 1)])
    return a


def _paper_light(p: np.ndarray) -> tuple[np.ndarray, int]:
    """Paper brightness on a small copy (local maximum, blurred, not too dark) and the shrink factor."""
    f = max(1, -(-max(p.shape) // ESTIMATE_EDGE))
    small = _shrunk(p, f).astype(np.int64)
    if not small.size:
        return small, f
    r, level = max(2, max(small.shape) // 40), _percentile(small, 0.95)
    light = _largest(small, r)
    for axis in (1, 0):
        total, n = _axis_sums(light, r, axis)
        light = total // n
    return np.maximum(light, max(1, int(level * 0.3))), f


def _flattened(p: np.ndarray) -> np.ndarray | None:
    """Every pixel over the paper brightness at its place; None where the page is too narrow for an estimate."""
    light, f = _paper_light(p)
    if not light.size:
        return None
    b, part = light.astype(np.float32), []
    for n, size in zip(light.shape, p.shape):
        s = (np.arange(size) + 0.5) / f - 0.5
        low = np.clip(np.floor(s), 0, n - 1).astype(int)
        part.append((low, np.minimum(low + 1, n - 1), np.clip(s - low, 0, 1).astype(np.float32)))
    (y0, y1, fy), (x0, x1, fx) = part
    one, fy = np.float32(1), fy[:, None]
    top = b[y0][:, x0] * (one - fx) + b[y0][:, x1] * fx
    bottom = b[y1][:, x0] * (one - fx) + b[y1][:, x1] * fx
    paper = np.maximum(one, top * (one - fy) + bottom * fy)
    return np.minimum(255, np.floor(p.astype(np.float32) * np.float32(255) / paper + np.float32(0.5)))


def flatten_background(pages: DataFrame) -> DataFrame:
    """Even white paper, ink kept; a colour page has each plane divided by its own estimate."""
    return pages.withColumn("vals", of(per_page(_flattened, BYTES))).filter("vals IS NOT NULL")


def _flattened_planes(p: np.ndarray) -> np.ndarray | None:
    planes = [_flattened(np.ascontiguousarray(p[..., c])) for c in range(3)]
    return None if any(x is None for x in planes) else np.stack(planes, -1)


def flatten_planes(pages: DataFrame) -> DataFrame:
    """:func:`flatten_background` of colour pages, channel by channel, so a tinted light goes too."""
    return pages.withColumn("vals", of(per_page(_flattened_planes, BYTES, planes=3))).filter("vals IS NOT NULL")


def background(pages: DataFrame) -> DataFrame:
    """The estimate itself as small pages, with ``f``, how much smaller."""
    f = F.greatest(F.lit(1), F.ceil(F.greatest("w", "h") / ESTIMATE_EDGE)).cast("int")
    d = pages.withColumn("vals", of(per_page(lambda p: _paper_light(p)[0], BYTES))).withColumn("f", f)
    return d.withColumns({c: F.floor(F.col(c) / F.col("f")).cast("int") for c in "wh"})


def _sharpened(p: np.ndarray, r: int, amount: float) -> np.ndarray:
    v, n = p.astype(np.int64), 2 * r + 1
    for axis in (1, 0, 1, 0):
        pad = np.pad(v, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        v = (sum(np.take(pad, np.arange(i, i + v.shape[axis]), axis) for i in range(n)) + n // 2) // n
    out = p.astype(np.float32) + np.float32(amount) * (p.astype(np.int64) - v).astype(np.float32)
    return np.where(out <= 0, 0, np.where(out >= 255, 255, np.floor(out + np.float32(0.5))))


def unsharp(pages: DataFrame, r: int, amount: float = S.UNSHARP_AMOUNT) -> DataFrame:
    return pages if r < 1 else pages.withColumn("vals", of(per_page(lambda p: _sharpened(p, r, amount), BYTES)))


look_up_of = per_page(lambda p, table: np.array(table)[p], BYTES)


def look_up(pages: DataFrame, table: Column) -> DataFrame:
    """Levels replaced through a table of 256 (an array column)."""
    return pages.withColumn("_t", table).withColumn("vals", of(look_up_of, F.col("_t"))).drop("_t")


def despeckle(pages: DataFrame, most: int) -> DataFrame:
    """Pieces of at most ``most`` pixels darker than 128 become paper."""
    def kernel(p):
        ink = p < 128
        return np.where(_specks(ink, most)[0], 255, p) if ink.any() else p

    return pages.withColumn("vals", of(per_page(kernel, BYTES)))


def black_white(pages: DataFrame, dpi: int = 100, darkness: int = 50) -> DataFrame:
    """Even lighting, sharpening, a soft adaptive threshold, specks removed."""
    gray = unsharp(flatten_background(pages), S.radius_for(dpi))
    return despeckle(sauvola(gray, S.window_for(dpi), S.k_for(darkness), 0.0, S.SMOOTH_RAMP), S.area_for(dpi))


# --- connected ink -----------------------------------------------------------------

def _around(a: np.ndarray, fn: Callable) -> np.ndarray:
    """``fn`` (a minimum or maximum) of each cell and its eight neighbours."""
    tall = a.copy()
    tall[1:] = fn(a[1:], a[:-1])
    tall[:-1] = fn(tall[:-1], a[1:])
    out = tall.copy()
    out[:, 1:] = fn(tall[:, 1:], tall[:, :-1])
    out[:, :-1] = fn(out[:, :-1], tall[:, 1:])
    return out


def _specks(ink: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ink pixels in 8-connected pieces of at most ``most``, and the smallest place in each piece (elsewhere without meaning).

    After ``most - 1`` rounds of taking the smallest place around, pixels of so small a piece
    agree; a set of pixels that agree is a piece exactly when none has another one beside it.
    """
    none = ink.size
    label = np.where(ink, np.arange(ink.size).reshape(ink.shape), none)
    for _ in range(most - 1):
        label = np.where(ink, _around(label, np.minimum), none)
    low, high = _around(label, np.minimum), _around(np.where(ink, label, -1), np.maximum)
    own = label[ink]
    size = np.bincount(own, minlength=none + 1)
    touched = np.bincount(own, weights=((low != label) | (high != label))[ink], minlength=none + 1) > 0
    small = np.zeros_like(ink)
    small[ink] = (size[own] <= most) & ~touched[own]
    return small, label


def ink_and_specks(ink: np.ndarray, most: int) -> tuple[int, int]:
    """Ink left without specks, and the number of specks."""
    if not ink.any():
        return 0, 0
    small, label = _specks(ink, most)
    return int(ink.sum() - small.sum()), len(np.unique(label[small]))


def _darker(p: np.ndarray, level: int, most: int) -> dict:
    ink, specks = ink_and_specks(p <= level, most)
    return {"ink": ink, "specks": specks}


ink_of = per_page(_darker, record(ink=T.LongType(), specks=T.LongType()))


# --- cuts and counts along an axis -------------------------------------------------

def _cut(p: np.ndarray, box: dict) -> np.ndarray:
    return p[box["y0"]:box["y1"], box["x0"]:box["x1"]]


cut_of = per_page(_cut, BYTES)


def cut(pages: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """The part ``[x0, x1) x [y0, y1)`` of each page."""
    d = pages.withColumn("_b", F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1")))
    d = d.withColumn("vals", of(cut_of, F.col("_b")))
    return d.withColumns({"w": F.col("_b.x1") - F.col("_b.x0"), "h": F.col("_b.y1") - F.col("_b.y0")}).drop("_b")


dark_rows_of = per_page(lambda p, level: (p < level).sum(1), LONGS)
dark_columns_of = per_page(lambda p, level, rows: (p[rows["top"]:rows["bottom"]] < level).sum(0), LONGS)


# --- whole-page checks -------------------------------------------------------------

def _digest(p: np.ndarray) -> dict:
    v = p.astype(np.int64)
    place = (np.arange(p.shape[0])[:, None] * 131 + np.arange(p.shape[1]) * 17) % 1009
    return {"n": v.size, "total": int(v.sum()), "placed": int((v * place).sum())}


digest_of = per_page(_digest, record(n=T.LongType(), total=T.LongType(), placed=T.LongType()))


def digest(pages: DataFrame) -> DataFrame:
    """``image_id, n, total, placed``: count, sum and position-weighted sum of the levels."""
    return pages.filter("h > 0 AND w > 0").select("image_id", of(digest_of).alias("d")).select("image_id", "d.*")
