"""Ranked lexical search: item vocabulary tiles times document impact tiles, dense and exact in float64.

Every item ranks all documents. Items are taken in blocks of bounded size; a block is what is
sent to the tasks, once for the counts (documents, terms, documents holding each item term)
and once for the scores. A task turns its documents into tiles: the impact of each item term
in each of a few hundred documents. Up to ``ITEMS`` items share a vocabulary, whose columns
are cut into tiles; an item matrix (weights times repeats) times an impact matrix is one BLAS
call for each pair of tiles. All entries are integers, and tiles are cut so that no partial
sum reaches 2**53, so the products are exact in any order of summation; tiles are added as
64-bit integers. Of each product only scores that reach the item's last kept one, ties
included, are looked at. Tasks return ``k`` rows an item at most, which meet in two steps.

No text is shuffled, and no table of postings is built. Memory of a task: a block of items,
one tile of each kind, and one document's words (a long text is counted piece by piece).

Defined results: a null text, or one without terms, is a document or item without terms: such
a document is not counted and not found, such an item has no rows. Repeated rows count as
documents, or items, of their own. Equal scores go by ascending ``doc_id``, null last. Columns
beside id and text are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import best, column, empty, staged, tiles

#: Rows an item gets.
TOP = 20
#: Bytes of item texts in a block, items and vocabulary columns of a matrix tile, documents of a tile and their bytes.
BLOCK, ITEMS, COLUMNS, DOCS, BYTES = 8 << 20, 256, 4096, 512, 8 << 20
#: A text is cut into terms so many bytes at a time.
PIECE = 1 << 20
#: Impacts stay below this (10**9 * tf / (1000 * tf + ...)).
IMPACT = 10**6
#: What the weights of a row of a tile may add up to, so that sums of products stay below 2**53.
HEAVIEST = (2**53 - 1) // IMPACT

# bytes that belong to terms (digits, letters, all above ASCII), A-Z in lower case; the others become spaces
_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists, cut at spaces about every ``PIECE`` bytes."""
    text, begin = (text or b"").translate(_TERMS), 0
    while begin < len(text):
        end = text.find(b" ", begin + PIECE) if len(text) - begin > PIECE else -1
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def counted(text: bytes | None) -> Counter:
    out: Counter = Counter()
    for part in terms(text):
        out.update(part)
    return out


class Items:
    """A block of items: its vocabulary and, after :meth:`weigh`, its matrix tiles."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        self.vocab: dict[bytes, int] = {}
        self.uids, self.counts = [], []
        for uid, text in rows:
            own = counted(text)
            if own:
                self.uids.append(uid)
                self.counts.append({self.vocab.setdefault(t, len(self.vocab)): n for t, n in own.items()})
        self.tiles: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]] = []
        self.n = self.length = 0

    def weigh(self, n: int, length: int, df: dict[int, int]) -> None:
        """Matrix tiles from the number of documents, their terms, and the documents holding each term."""
        self.n, self.length = n, length
        w = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocab))]
        for at in range(0, len(self.uids), ITEMS):
            some = self.counts[at:at + ITEMS]
            most: Counter = Counter()
            for own in some:
                for t, c in own.items():
                    most[t] = max(most[t], c)
            columns = []  # (term, part of its repeats, parts): repeats too heavy for one column are shared out
            for t in sorted(most):
                parts = -(-w[t] * most[t] // HEAVIEST) or 1
                columns += [(t, p, parts) for p in range(parts)]
            cut: list[list[tuple[int, int, int]]] = []
            held = HEAVIEST + 1
            for c in columns:
                weight = w[c[0]] * (-(-most[c[0]] // c[2]))
                if held + weight > HEAVIEST or len(cut[-1]) >= COLUMNS:
                    cut.append([])
                    held = 0
                cut[-1].append(c)
                held += weight
            mats = []
            for part in cut:
                m = np.zeros((len(some), len(part)))
                where = {}
                for j, c in enumerate(part):
                    where.setdefault(c[0], []).append((j, c))
                for i, own in enumerate(some):
                    for t in own.keys() & where.keys():
                        for j, (_, p, parts) in where[t]:
                            m[i, j] = w[t] * (own[t] // parts + (p < own[t] % parts))
                mats.append((np.array([c[0] for c in part]), m))
            self.tiles.append((at, mats))


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value.vocab
        df, docs, length = np.zeros(len(vocab), np.int64), 0, 0
        for batch in batches:
            for blob in batch.column(0):
                own = counted(blob.as_py())
                if own:
                    docs += 1
                    length += own.total()
                    df[[vocab[t] for t in own.keys() & vocab.keys()]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at], pa.int64()), pa.array([docs, length, *df[at]], pa.int64())], names=["term", "n"])

    return run


class _Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.last = k, np.ones(items, np.int64)  # a score has to reach `last`
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def take(self, at: int, scores: np.ndarray, ids: list[int | None]) -> None:
        reach = scores >= self.last[at:at + len(scores), None]
        for i in np.flatnonzero(reach.any(axis=1)):
            own = self.rows[at + i]
            own += [(-int(scores[i, j]), ids[j] is None, ids[j] or 0) for j in np.flatnonzero(reach[i])]
            own.sort()
            del own[self.k:]
            if len(own) == self.k:
                self.last[at + i] = -own[-1][0]


def _ranker(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = shared.value
        vocab, found = block.vocab, _Best(len(block.uids), k)
        for batch in batches:
            for tile in tiles(batch, 1, DOCS, BYTES):
                ids, term, doc, impact = [], [], [], []
                for ident, blob in zip(tile.column(0).to_pylist(), tile.column(1)):
                    own = counted(blob.as_py())
                    held = own.keys() & vocab.keys()
                    if not held:
                        continue
                    m = 100 - 25 + 25 * own.total() * block.n // block.length
                    tf = np.array([own[t] for t in held], np.int64)
                    term += [vocab[t] for t in held]
                    doc += [len(ids)] * len(tf)
                    impact.append(10**9 * tf // (1000 * tf + 12 * m))
                    ids.append(ident)
                if not ids:
                    continue
                order = np.argsort(term, kind="stable")
                term, doc, impact = np.array(term)[order], np.array(doc)[order], np.concatenate(impact)[order]
                for at, mats in block.tiles:
                    scores = 0
                    for columns, weights in mats:
                        lo, hi = np.searchsorted(term, columns), np.searchsorted(term, columns, "right")
                        n = hi - lo
                        row = np.repeat(np.arange(len(columns)), n)
                        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                        dense = np.zeros((len(columns), len(ids)))
                        dense[row, doc[entry]] = impact[entry]
                        scores = scores + (weights @ dense).astype(np.int64)
                    found.take(at, scores, ids)
        rows = [(uid, None if none else ident, -score) for uid, own in zip(block.uids, found.rows) for score, none, ident in own]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, names=["uid", "doc_id", "score"])

    return run


def blocks(items: DataFrame, most: int = BLOCK) -> tuple[DataFrame, int]:
    """Staged ``(uid, item_id, text, block)`` and the number of blocks; a block holds about ``most`` bytes of text, or one item."""
    rows = staged(items.withColumn("uid", F.monotonically_increasing_id()), "items")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // most))
    while True:
        block = F.pmod(F.xxhash64("uid"), F.lit(n))
        held = rows.groupBy(block.alias("block")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c"))
        if n > 64 * (1 + total // most) or not held.filter((F.col("s") > 2 * most) & (F.col("c") > 1)).take(1):
            return rows.withColumn("block", block), n
        n *= 2


def ranking(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString() if item_col in items.columns else "long"
    named = items.select(column(items, item_col, kind).alias("item_id"), column(items, item_text, "string").cast("binary").alias("text"))
    rows = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").cast("binary").alias("text"))
    named, n = blocks(named, block_bytes)
    found = empty(spark, "uid long, doc_id long, score long")
    for b in range(n):
        block = Items([tuple(r) for r in named.filter(F.col("block") == b).select("uid", "text").collect()])  # `block_bytes`, or one item
        if not block.uids:
            continue
        seen = rows.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(block)), "term long, n long")
        sums = {r.term: r.n for r in seen.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if not sums.get(-2):
            break
        block.weigh(sums.pop(-1), sums.pop(-2), sums)
        found = found.unionByName(rows.mapInArrow(_ranker(spark.sparkContext.broadcast(block), k), "uid long, doc_id long, score long"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return best(found, ["uid"], order, k).join(named.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")
