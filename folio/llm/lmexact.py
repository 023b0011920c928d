"""Cross-entropy difference with exact counts: every word and every pair of words has a count of its own.

The two models and the score are those of ``lmscore``; what differs is that no slots are shared.
Documents are packed into chunks of about ``CHUNK`` words (a word is known by its 64-bit hash, a
pair by a 64-bit hash of both: among a billion different ones 0.03 equal hashes are expected).
A chunk sends each of its *different* words and pairs once, with its counts, to the part that
owns the range of hashes; the part adds up what all chunks sent and answers each chunk with the
totals over all documents, in the order in which it was asked. So what is gathered grows with
the corpus, nothing is broadcast or sent to the driver but three sums, and a task holds a chunk
or one part at a time, whose size depends neither on the corpus nor on the number of tasks.

p(w|v) = (c(v, w) + A * p(w)) / (c(v) + A), p(w) = (c(w) + B / V) / (N + B), V the different words of all documents.

Defined results: as in ``lmscore``. Rows with the id of a target row are target rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, staged
from folio.llm.lmscore import A, B, CACHE, held_out, target_rows

#: Words of a chunk, at least (a text is never cut); words of the corpus for one part; the least number of parts.
CHUNK, PART, PARTS = 1 << 21, 1 << 21, 256
#: Parts that a task answers one after the other.
PARTS_A_TASK = 8
WORDS, PAIRS = 0, 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

CHUNKS = "chunk long, n long, ids array<long>, sizes array<long>, words binary, vocab binary"
ASKED = "part long, kind int, chunk long, keys binary, counts binary"
ANSWERS = "chunk long, part long, kind int, counts binary, words long, n_all long, n_target long"
SCORES = "doc_id long, n_words long, target_loss double, background_loss double"


def packed(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


class Hashes(dict):
    """Word -> 64-bit hash; 0 is the start mark."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = max(1, xxhash.xxh64_intdigest(word))
        return found


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = before * MIX[0]
    x = ((x ^ (x >> np.uint64(32))) + words) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


def parts_for(words: int) -> int:
    parts = PARTS
    while parts * PART < words:
        parts *= 4
    return parts


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of hashes a key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _chunker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, at = Hashes(), TaskContext.get().partitionId(), 0
        ids, sizes, held, n = [], [], [], 0

        def row():
            vocab, words = np.unique(np.concatenate(held), return_inverse=True)
            return pa.RecordBatch.from_pylist([{"chunk": (task << 32) + at, "n": n, "ids": ids, "sizes": sizes, "words": packed(words.astype(np.uint32)),
                                                "vocab": packed_keys(vocab)}], CHUNK_TYPES)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").lower().split()
                ids.append(ident)
                sizes.append(len(words))
                held.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                n += len(words)
                if n >= size:
                    yield row()
                    ids, sizes, held, n, at = [], [], [], 0, at + 1
        if ids:
            yield row()

    return run


CHUNK_TYPES = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("vocab", pa.binary())])


class Chunk:
    """A chunk read back: the keys it asks for and how its words point to them."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        vocab = unpacked_keys(row["vocab"])
        #: Keys of words: the start mark, then the words in order of their hash.
        self.keys = np.concatenate([np.zeros(1, np.uint64), vocab])
        self.words = unpacked(row["words"], np.uint32).astype(np.int64) + 1
        self.before = np.concatenate([[0], self.words[:-1]]) if len(self.words) else self.words
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        self.pairs, self.pair_of = np.unique(pair_keys(self.keys[self.before], self.keys[self.words]), return_inverse=True)


def _asker(parts: int):
    """The rows a chunk sends: of each part the keys in order, and counts in all and in target texts (of words also as contexts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = Chunk(row)
                chosen = np.zeros(len(c.sizes), bool)
                chosen[row["marks"] or []] = True
                chosen = np.repeat(chosen, c.sizes)
                counts = {WORDS: [np.bincount(x, minlength=len(c.keys)) for x in (c.words, c.words[chosen], c.before, c.before[chosen])],
                          PAIRS: [np.bincount(x, minlength=len(c.pairs)) for x in (c.pair_of, c.pair_of[chosen])]}
                for kind, keys in ((WORDS, c.keys), (PAIRS, c.pairs)):
                    ends = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
                    table = np.array(counts[kind], np.int64)
                    rows = [{"part": p, "kind": kind, "chunk": row["chunk"], "keys": packed_keys(keys[i:j]), "counts": packed(table[:, i:j].ravel())}
                            for p, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if j > i]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, ASKED_TYPES)

    return run


ASKED_TYPES = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _answers(part: int, kind: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    keys = [unpacked_keys(k) for _, k, _ in rows]
    different, where = np.unique(np.concatenate(keys), return_inverse=True)
    wide = 4 if kind == WORDS else 2
    totals, at = np.zeros((wide, len(different)), np.int64), 0
    for own, (_, _, counts) in zip(keys, rows):
        totals[:, where[at:at + len(own)]] += unpacked(counts, np.int64).reshape(wide, -1)  # a chunk's keys are all different
        at += len(own)
    at, sums = 0, (int((different > 0).sum()), int(totals[0].sum()), int(totals[1].sum())) if kind == WORDS else (0, 0, 0)
    for own, (chunk, _, _) in zip(keys, rows):
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "part": part, "kind": kind, "counts": packed(totals[:, where[at:at + len(own)]].ravel()),
                                           "words": sums[0], "n_all": sums[1], "n_target": sums[2]}], ANSWER_TYPES)
        at, sums = at + len(own), (0, 0, 0)


def _answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what came to a part and answers every chunk with the totals; one row of a part has its sums.

    Rows come sorted by part and kind, and a part is answered when its last row is there: no more than one is held."""
    now, came = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["part"], row["kind"]):
                if came:
                    yield from _answers(*now, came)
                now, came = (row["part"], row["kind"]), []
            came.append((row["chunk"], row["keys"], row["counts"]))
    if came:
        yield from _answers(*now, came)


ANSWER_TYPES = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("counts", pa.binary()), ("words", pa.int64()), ("n_all", pa.int64()), ("n_target", pa.int64())])


def losses(c: Chunk, words: np.ndarray, pairs: np.ndarray, v: int, n_all: int, n_target: int) -> list[np.ndarray]:
    """Loss of each word of a chunk under target and background, from counts over all documents."""
    models = [(0, n_all, n_target / max(1, n_all))]
    models.insert(0, (1, n_target, 1.0) if n_target else (0, n_all, 1.0))
    if not n_target:
        models[1] = models[0]
    out = []
    for k, n, scale in models:
        uni = (words[k] * scale + B / max(1, v)) / (n * scale + B)
        out.append(-np.log((pairs[k][c.pair_of] * scale + A * uni[c.words]) / (words[2 + k][c.before] * scale + A)))
    return out


def _scorer(v: int, n_all: int, n_target: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        c = Chunk(row)
        got = {WORDS: [], PAIRS: []}
        for a in sorted(answers.select(["part", "kind", "counts"]).to_pylist(), key=lambda a: a["part"]):
            got[a["kind"]].append(unpacked(a["counts"], np.int64).reshape(4 if a["kind"] == WORDS else 2, -1))
        words = np.concatenate(got[WORDS], 1)
        pairs = np.concatenate(got[PAIRS], 1) if got[PAIRS] else np.zeros((2, 0), np.int64)
        full = c.sizes > 0
        means = []
        for loss in losses(c, words, pairs, v, n_all, n_target):
            mean = np.zeros(len(c.sizes))
            if full.any():
                mean[full] = np.add.reduceat(loss, (np.cumsum(c.sizes) - c.sizes)[full]) / c.sizes[full]
            means.append(mean)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_words": c.sizes, "target_loss": means[0], "background_loss": means[1]})

    return run


def scored(docs: DataFrame, target: DataFrame, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, target_loss, background_loss, score``; ``target(id)`` has the ids of target rows, each once.

    ``tasks`` is the number of tasks that answer; by default it grows with the corpus."""
    rows = docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").cast("binary").alias("text"))
    chunks = staged(rows.mapInArrow(_chunker(chunk), CHUNKS), "chunks")
    parts = parts_for(chunks.agg(F.sum("n")).first()[0] or 0)
    # the same plan at every size: target ids and chunks are never broadcast
    ids = chunks.select("chunk", F.posexplode("ids").alias("at", "id"))
    marks = ids.join(target.select(F.col("id").alias("wanted")).hint("merge"), F.col("id") == F.col("wanted")).groupBy("chunk").agg(F.collect_list("at").alias("marks"))
    asked = chunks.join(marks.hint("merge"), "chunk", "left").mapInArrow(_asker(parts), ASKED)
    dealt = asked.repartition(tasks or parts // PARTS_A_TASK, "part").sortWithinPartitions("part", "kind")
    answers = staged(dealt.mapInArrow(_answerer, ANSWERS), "answers")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n_all", "n_target")]).first()
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(*sums), SCORES)
    return found.withColumn("score", F.col("background_loss") - F.col("target_loss"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return scored(docs, target_rows(labels), chunk).select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_words", "target_loss", "background_loss", "score")
