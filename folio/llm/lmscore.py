"""Cross-entropy difference: how much more a document looks like a target than like the corpus.

Two bigram models share one vocabulary (words hashed to ``2**VOCAB`` ids), one table shape,
one smoothing and one effective size: the background counts of *all* documents are scaled to
the number of words of the target, so a model is never better for having seen more text. The
target is the rows labelled ``quality = 1`` that are not held out. Per word the loss is
``-log p(word | word before)``; the score is the background's mean loss minus the target's.

p(w|v) = (c(v, w) + A * p(w)) / (c(v) + A), p(w) = (c(w) + B / V) / (N + B).

Counts cover every word of every document; they are added up in each task and then between
tasks, so what is gathered grows with the corpus, while a model stays within
``2**VOCAB + 2**PAIRS`` numbers: that bound is what a task loads. Hash collisions join
counts of two words and drop none.

Defined results: a null or wordless text has 0 words and score 0; a text's first word is
scored after a start mark; without any target row both models are the smoothed background, so
every score is 0 or near it; repeated rows count and score again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, crc_bucket

VOCAB, PAIRS = 18, 21
A, B = 8.0, 1.0
#: Words whose ids a worker keeps.
CACHE = 400_000
#: Words counted together, at least.
TOGETHER = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """Word -> id in ``1 .. 2**VOCAB - 1``; 0 is the start mark."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = max(1, xxhash.xxh64_intdigest(word) & self.mask)
        return found


def word_ids(text: bytes | None, ids: Ids) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def pair_slots(words: np.ndarray, vocab: int, pairs: int) -> np.ndarray:
    """The slot of each word with the one before it; the first follows the start mark 0."""
    before = np.concatenate([[0], words[:-1]]) if len(words) else words
    code = (before.astype(np.uint64) << np.uint64(vocab)) + words.astype(np.uint64)
    return ((code * MULTIPLIER) >> np.uint64(64 - pairs)).astype(np.int64)


#: Slots of a block of counts, and tasks whose blocks are added up before all are.
BLOCK, NEAR = 1 << 14, 64
COUNTS = "block long, task long, target binary, background binary"


def _shrunk(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int64)


def _rows(blocks: Iterable[tuple[int, np.ndarray, np.ndarray]], task: int) -> Iterator[pa.RecordBatch]:
    for block, target, background in blocks:
        yield pa.RecordBatch.from_pylist([{"block": block, "task": task, "target": _shrunk(target), "background": _shrunk(background)}])


def _counter(vocab: int, pairs: int):
    """A task's counts of words, contexts and pairs (in slots one after the other), in dense blocks."""
    wide = -(-((2 << vocab) + (1 << pairs)) // BLOCK) * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, totals = Ids(vocab), [np.zeros(wide, np.int64), np.zeros(wide, np.int64)]
        waiting, held = [[], []], 0

        def settle():
            for kind in (0, 1):
                if waiting[kind]:
                    totals[kind] += np.bincount(np.concatenate(waiting[kind]), minlength=wide)
                    waiting[kind] = []

        for batch in batches:
            texts, marks = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                words = word_ids(texts[row].as_py(), ids)
                if not len(words):
                    continue
                slots = [words, np.concatenate([[0], words[:-1]]) + (1 << vocab), pair_slots(words, vocab, pairs) + (2 << vocab)]
                waiting[1] += slots
                if marks[row].as_py():
                    waiting[0] += slots
                held += len(words)
                if held >= TOGETHER:
                    settle()
                    held = 0
        settle()
        cut = [t.reshape(-1, BLOCK) for t in totals]
        yield from _rows(((k, t, b) for k, (t, b) in enumerate(zip(*cut)) if b.any()), TaskContext.get().partitionId())

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the blocks that come to a task, one row at a time."""
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = sums.setdefault((row["block"], row["task"]), [np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)])
            own[0] += unpacked(row["target"])
            own[1] += unpacked(row["background"])
    for (block, task), (target, background) in sums.items():
        yield from _rows([(block, target, background)], task)


def counted(docs: DataFrame, target: DataFrame, vocab: int = VOCAB, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(block, target, background)`` over all documents: one row for each ``BLOCK`` slots that occur.

    ``target(id)`` has the ids of the target rows, each once. Blocks of counts are far smaller than
    rows of them; they are added up among groups of tasks first and then among the groups, as they stream in.
    """
    rows = docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").cast("binary").alias("text"))
    wanted = target.select(F.col("id").alias("wanted"))
    # the same plan at every size: target ids grow with the labels, so they are never broadcast
    marked = rows.join(wanted.hint("merge"), F.col("id") == F.col("wanted"), "left").select("text", F.col("wanted").isNotNull().alias("mark"))
    parts = marked.mapInArrow(_counter(vocab, pairs), COUNTS)
    for group in (F.floor(F.col("task") / NEAR), F.lit(0).cast("long")):
        parts = parts.withColumn("task", group).repartition("block", "task").mapInArrow(_adder, COUNTS)
    return parts.drop("task")


class Model:
    """Both models over the shared slots, from dense counts."""

    def __init__(self, target: np.ndarray, background: np.ndarray, vocab: int, pairs: int):
        self.vocab, self.pairs = vocab, pairs
        word = 1 << vocab
        n_target, n_all = float(target[:word].sum(dtype=float)), float(background[:word].sum(dtype=float))
        if not n_target:
            target, n_target = background, n_all
        self.parts = []
        for counts, scale in ((target, 1.0), (background, n_target / max(1.0, n_all))):
            uni = counts[:word].astype(float) * scale
            uni = (uni + B / word) / (uni.sum() + B)
            ctx, pair = counts[word:2 * word] * np.float32(scale), counts[2 * word:] * np.float32(scale)
            self.parts.append((uni.astype(np.float32), ctx, pair))

    def entropies(self, words: np.ndarray) -> tuple[float, float]:
        """Mean loss of a text under target and background."""
        if not len(words):
            return 0.0, 0.0
        before, slots = np.concatenate([[0], words[:-1]]), pair_slots(words, self.vocab, self.pairs)
        out = []
        for uni, ctx, pair in self.parts:
            p = (pair[slots] + A * uni[words].astype(np.float64)) / (ctx[before] + A)
            out.append(float(-np.log(np.minimum(p, 1.0)).mean()))
        return out[0], out[1]


def model(docs: DataFrame, target: DataFrame, vocab: int = VOCAB, pairs: int = PAIRS, **columns) -> Model:
    """Both models. However large the corpus, ``2 * 2**vocab + 2**pairs`` pairs of numbers reach the driver, compressed."""
    size = -(-((2 << vocab) + (1 << pairs)) // BLOCK) * BLOCK
    dense = {kind: np.zeros(size, np.float32) for kind in ("target", "background")}
    for row in counted(docs, target, vocab, pairs, **columns).collect():
        for kind, whole in dense.items():
            whole[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = unpacked(row[kind])
    return Model(dense["target"], dense["background"], vocab, pairs)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids = Ids(m.vocab)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = word_ids(text.as_py(), ids)
                rows.append((len(words), *m.entropies(words)))
            n, t, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(t, pa.float64()), pa.array(b, pa.float64())],
                                             names=["doc_id", "n_words", "target_loss", "background_loss"])

    return run


def scored(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, target_loss, background_loss, score`` (higher: more like the target)."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    rows = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").cast("binary").alias("text"))
    out = rows.mapInArrow(_scorer(shared), "doc_id long, n_words long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))


def held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, 5) == 0


def target_rows(labels: DataFrame) -> DataFrame:
    """Ids of rows labelled as good quality, without those held out."""
    rows = labels.select(column(labels, "doc_id", "long").alias("id"), column(labels, "quality", "int").alias("quality"))
    return rows.filter((F.col("quality") == 1) & ~held_out("id")).select("id").distinct()


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, vocab: int = VOCAB, pairs: int = PAIRS) -> DataFrame:
    return scored(docs, model(docs, target_rows(labels), vocab, pairs)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_words", "target_loss", "background_loss", "score")
