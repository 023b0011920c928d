"""Exact top-k inner products by MaxScore over shards of signed postings.

A vector of integers is a document whose terms are its components: term j holds the vectors
with a component j that is not zero, with the component as its impact, which may be negative.
Vectors are dealt to shards of bounded size, each with its postings and the largest and
smallest impact of every term, so that a query's term adds at most ``bound = max(q * largest,
q * smallest, 0)`` within a shard. A list that holds a good part of the shard is kept as a
whole column.

For each query and shard: terms are ordered by their bounds; those at the end whose bounds
together stay below the query's k-th best score so far are non-essential, because a vector
found in none of the other lists cannot get among the best. The postings of the essential
terms are added up; the vectors met there are then probed in the remaining terms, in order of
their bounds, for as long as their sum and the bounds left still reach the k-th best score
(equal scores included, so ties are decided by id alone). The first rows of the first shard
are scored in full to have a k-th best score to start from.

Queries are a stated set. Blocks of queries meet groups of shards: both are packed rows, sent
to the cell (block, group) by one shuffle; a cell keeps its k-th best scores from shard to
shard and returns ``k`` rows a query, which are merged in two steps. There are at most
``GROUPS`` groups, so rows to merge grow with the queries only. A task holds one block and one
shard at a time.

Defined results: vectors that are null or hold a null or non-finite component take no part; an
empty vector scores 0 with all; a shorter vector counts as ending in zeros. The rows of a
query are those of its id, so it meets none of them; repeated query rows are ranked once each.
A null id is never a query and comes last among equal scores. Components outside 64 bits
saturate, scores wrap; where that could happen nothing is pruned. Other columns are ignored,
whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import best, column, staged

#: Rows a query gets, and every how many-th id is a query.
TOP, EVERY = 20, 20
#: Components of a shard and of a block of queries (rows times dimensions), and rows of either at most.
SHARD, BLOCK, ROWS = 1 << 18, 1 << 16, 1 << 14
#: Shards of a group at least, and groups at most.
GROUP, GROUPS = 4, 256
#: Rows scored in full before there is a k-th best score, and terms probed between two looks at the candidates.
SEED, PROBE = 256, 8
#: A list with more than one in so many rows of its shard is a whole column.
SPARSE = 8

PACKED = "block int, n int, dim int, uids binary, ids binary, none binary, matrix binary, width int"


def integers(vector: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x * scale)))


def _pack(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], block: int) -> tuple:
    uids, ids, none = (np.concatenate([r[i] for r in rows]) for i in range(3))
    dim = max((int(r[4].max(initial=0)) for r in rows), default=0)
    matrix = np.zeros((len(uids), dim), np.int64)
    at = 0
    for r in rows:
        lens, begin = r[4], np.cumsum(r[4]) - r[4]
        row = np.repeat(np.arange(len(lens)), lens)
        matrix[at + row, np.arange(len(r[3])) - np.repeat(begin, lens)] = r[3]
        at += len(lens)
    most = int(max(-int(matrix.min(initial=0)) - 1, int(matrix.max(initial=0))))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return block, len(uids), dim, uids.tobytes(), ids.tobytes(), none.tobytes(), matrix.astype(f"<i{width}").tobytes(), width


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, uid, id, ints)`` in order of block; one packed row for each block."""
    schema = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), *[(x, pa.binary()) for x in ("uids", "ids", "none", "matrix")], ("width", pa.int32())])
    now, held = None, []

    def done():
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, _pack(held, now)))], schema=schema)

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and blocks[lo] != now:
                yield done()
                held = []
            now, part = int(blocks[lo]), batch.slice(lo, hi - lo)
            ids, ints = part.column(2), part.column(3)
            held.append((part.column(1).to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(ids.is_null()),
                         ints.flatten().to_numpy(zero_copy_only=False), np.diff(ints.offsets.to_numpy()).astype(np.int64)))
    if held:
        yield done()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    matrix = np.frombuffer(row["matrix"], f"<i{row['width']}").reshape(row["n"], row["dim"]).astype(np.int64)
    return np.frombuffer(row["uids"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool), matrix


class Shard:
    """Postings of a shard with the extreme impacts of each term; dense lists as whole columns."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, matrix: np.ndarray):
        self.ids, self.none = ids, none
        self.scale = float(np.abs(matrix.astype(float)).max(initial=0))
        self.columns = np.ascontiguousarray(matrix.T)  # read by row when vectors are probed
        self.low, self.high = (f(self.columns, axis=1, initial=0) for f in (np.min, np.max))
        self.postings: list[tuple[np.ndarray, np.ndarray] | None] = []
        for c in self.columns:
            rows = np.flatnonzero(c)
            self.postings.append(None if SPARSE * len(rows) > len(c) else (rows, c[rows]))

    def fitted(self, q: np.ndarray) -> np.ndarray:
        """The query with as many components as the shard has."""
        dim = len(self.columns)
        return np.concatenate([q[:dim], np.zeros(max(0, dim - len(q)), np.int64)])

    def scored(self, q: np.ndarray, rows: slice) -> np.ndarray:
        return q @ self.columns[:, rows] if len(q) else np.zeros(len(self.ids[rows]), np.int64)

    def reaching(self, q: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score may be ``least`` or more and their scores, by MaxScore; all rows without ``least``."""
        q = self.fitted(q)
        most = float(np.abs(q.astype(float)).max(initial=0)) * self.scale * max(1, len(q))
        if least is None or least <= 0 or most >= 2**62:
            return np.arange(len(self.ids)), self.scored(q, slice(None))  # a vector in no list at all may be among the best
        bound = np.maximum(np.maximum(q * self.low, q * self.high), 0)
        order = np.argsort(-bound, kind="stable")
        order = order[q[order] != 0]
        left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from here on can add
        essential = int(np.argmax(left < least))
        total, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for j in order[:essential]:
            if self.postings[j] is None:
                total += q[j] * self.columns[j]
                seen |= self.columns[j] != 0
            else:
                rows, impact = self.postings[j]
                total[rows] += q[j] * impact
                seen[rows] = True
        rows = np.flatnonzero(seen & (total + left[essential] >= least))
        total = total[rows]
        for at in range(essential, len(order), PROBE):
            for j in order[at:at + PROBE]:
                total += q[j] * self.columns[j][rows]
            going = total + left[min(at + PROBE, len(order))] >= least
            rows, total = rows[going], total[going]
        return rows, total


class Best:
    """The ``k`` best rows of one query so far: highest scores, then smallest ids, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None

    def take(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.id, ids])
        if len(score) > 4 * self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, none, ids = score[keep], none[keep], ids[keep]
        order = np.lexsort((ids, none, ~score))[:self.k]
        self.score, self.none, self.id = score[order], none[order], ids[order]


def search(shard: Shard, q: np.ndarray, own: int, found: Best) -> None:
    """Add to ``found`` what the shard has for one query; rows with the id ``own`` are left out."""

    def add(rows: np.ndarray, scores: np.ndarray) -> None:
        other = shard.none[rows] | (shard.ids[rows] != own)
        found.take(scores[other], shard.none[rows][other], shard.ids[rows][other])

    begin = 0
    if found.least is None:
        begin = min(SEED, len(shard.ids))
        add(np.arange(begin), shard.scored(shard.fitted(q), slice(begin)))
    rows, scores = shard.reaching(q, found.least)
    add(rows[rows >= begin], scores[rows >= begin])


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, found = None, None, []

        def done() -> pa.RecordBatch:
            n = [len(f.score) for f in found]
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries[0], n)), pa.array(np.repeat(queries[1], n)),
                 pa.array(join([f.id for f in found], np.int64), mask=join([f.none for f in found], bool)), pa.array(join([f.score for f in found], np.int64))],
                names=["uid", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["cell"] != cell:
                    if found:
                        yield done()
                    cell, queries, found = row["cell"], None, []
                if row["query"]:
                    queries = _unpacked(row)
                    found = [Best(k) for _ in queries[0]]
                elif queries is not None:
                    _, ids, none, matrix = _unpacked(row)
                    shard = Shard(ids, none, matrix)
                    for q, own, f in zip(queries[3], queries[1], found):
                        search(shard, q, int(own), f)
        if found:
            yield done()

    return run


def _packed(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``rows(uid, id, ints)`` dealt to ``n`` packed blocks by hash."""
    dealt = rows.select(F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("block"), "uid", "id", "ints")
    dealt = dealt.repartition(max(1, min(n, 20_000)), "block").sortWithinPartitions("block")
    return staged(dealt.mapInArrow(_packer, PACKED), name)


def top(vectors: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
        shard: int = SHARD, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each row whose id ``every`` divides, against all rows."""
    given = vectors.select(column(vectors, id_col, "long").alias("id"), column(vectors, vector_col, "array<double>").alias("vector"))
    rows = given.select("id", integers(F.col("vector"), scale).alias("ints")).filter("ints is not null")
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asks = rows.filter(F.col("id") % every == 0)
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    n_asks = asks.count()
    per = lambda cells: max(1, min(ROWS, cells // max(1, dim)))
    n_blocks, n_shards = max(1, -(-n_asks // per(block))), max(1, -(-n // per(shard)))
    group = max(group, -(-n_shards // GROUPS))
    n_groups = -(-n_shards // group)
    queries = _packed(asks, n_blocks, "queries").withColumn("query", F.lit(True)).withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    shards = _packed(rows, n_shards, "shards").withColumn("query", F.lit(False)).withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    queries = queries.withColumn("cell", F.col("block").cast("long") * n_groups + F.col("meets"))
    shards = shards.withColumn("cell", F.col("meets").cast("long") * n_groups + F.floor(F.col("block") / group))
    cells = queries.unionByName(shards).repartitionByRange(min(n_blocks * n_groups, 50_000), "cell").sortWithinPartitions("cell", F.col("query").desc())
    found = cells.mapInArrow(_searcher(k), "uid long, query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    return best(found, ["uid"], order, k).select("query_id", "rank", "vec_id", "score")
