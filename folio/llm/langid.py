"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum over *all* ways to cut it into pieces, found by the forward algorithm;
a text's is the product over its words, and the posterior over languages (equal priors) gives
the prediction and its score.

Fitting is expectation maximisation: the forward-backward algorithm gives the expected uses
of each piece in the words of a language, which become its new probabilities. Words are
counted over a bounded sample of labelled rows (``PER_LANG`` documents of each language, those
with the smallest hash of the id); one task fits one language. Scoring streams over batches:
words of a batch are scored once each, in numpy, all words of one length together.

Words are runs of letters in lower case, with the vocabulary's word-start mark in front.
Defined results: text null or without a letter gives ``und`` with score 0; characters outside
the vocabulary and the pieces a language never used get a floor probability; with no labelled
row at all every text is ``und``; ties go to the language that comes first by name.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.llm.common import column, crc_bucket, unwrapped, wrapped

#: The vocabulary file (a parameter everywhere; never copied).
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language that are fitted on.
PER_LANG = 600
ROUNDS = 4
LONGEST = 12  # letters of a piece, with the mark
WIDE = 40  # words up to so long are scored in numpy together; longer ones one at a time
FLOOR = 1e-7
CACHE = 200_000  # words whose scores a worker keeps
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """Pieces of letters only (the mark apart), in lower case, in the order of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    seen = dict.fromkeys(model.id_to_piece(i) for i in range(model.get_piece_size()))
    return tuple(p for p in seen if len(p) <= LONGEST and p == p.lower() and (p == MARK or p.lstrip(MARK).isalpha()) and MARK not in p[1:])


class Pieces:
    """Looks up pieces by a rolling hash of their characters."""

    def __init__(self, path: str):
        self.names = vocabulary(path)
        self.index = {p: i for i, p in enumerate(self.names)}
        keys = np.array([self.key(p) for p in self.names], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c)) * int(MIX)) & 0xFFFFFFFFFFFFFFFF
        return h

    def ids(self, codes: np.ndarray, start: int, n: int) -> np.ndarray:
        """The piece at ``start`` with ``n`` characters in each row of ``codes``, or -1."""
        h = np.zeros(len(codes), np.uint64)
        for j in range(start, start + n):
            h = (h + codes[:, j]) * MIX
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.order[at], -1)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_length(words: Iterable[str]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Words with the mark in front, as rows of code points, by length."""
    groups: dict[int, list[int]] = {}
    words = list(words)
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, members in groups.items():
        for at in range(0, len(members), max(1, 1_000_000 // (n + 1))):
            some = members[at:at + max(1, 1_000_000 // (n + 1))]
            flat = np.frombuffer("".join(MARK + words[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield n + 1, some, flat.reshape(len(some), n + 1).astype(np.uint64)


def log_words(words: list[str], probs: np.ndarray, found: Pieces) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns); ``probs`` is piece x language with a floor row at the end."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, members, codes in _by_length(words):
        if n > WIDE:
            for i, row in zip(members, codes):
                out[i] = _log_long(row, probs, found)
            continue
        alpha = [np.ones((len(members), probs.shape[1]))]
        for end in range(1, n + 1):
            total = np.zeros_like(alpha[0])
            for size in range(1, min(LONGEST, end) + 1):
                ids = found.ids(codes, end - size, size)
                if size == 1:
                    total += alpha[end - 1] * probs[ids]  # -1 is the floor row
                else:
                    hit = np.flatnonzero(ids >= 0)
                    if len(hit):
                        total[hit] += alpha[end - size][hit] * probs[ids[hit]]
            alpha.append(total)
        out[members] = np.log(alpha[n])
    return out


def _log_long(row: np.ndarray, probs: np.ndarray, found: Pieces) -> np.ndarray:
    """The same for one word of any length: sums are scaled as they go."""
    codes, n = row.reshape(1, -1), len(row)
    names = "".join(map(chr, row.tolist()))
    index, recent, scale = found.index, [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    del codes
    for end in range(1, n + 1):
        total = recent[-1] * probs[index.get(names[end - 1], -1)]
        for size in range(2, min(LONGEST, end) + 1):
            at = index.get(names[end - size:end])
            if at is not None:
                total = total + recent[-size] * probs[at]
        recent = [r / total for r in recent[-LONGEST + 1:]] + [np.ones_like(total)]
        scale += np.log(total)
    return scale


def expected_uses(words: list[str], counts: np.ndarray, prob: np.ndarray, found: Pieces) -> np.ndarray:
    """How often each piece is used in ``words`` (each ``counts`` times), summed over all segmentations."""
    uses, column_ = np.zeros(len(prob)), prob.reshape(-1, 1)
    for n, members, codes in _by_length(words):
        if n > WIDE:
            continue  # in fitting only: a run of letters this long tells nothing about pieces
        spans = {(end - size, size): found.ids(codes, end - size, size) for end in range(1, n + 1) for size in range(1, min(LONGEST, end) + 1)}
        value = lambda s, z: np.where(spans[s, z] >= 0, column_[spans[s, z], 0], FLOOR if z == 1 else 0.0)
        fore, back = [np.ones(len(members))], [None] * n + [np.ones(len(members))]
        for end in range(1, n + 1):
            fore.append(sum(fore[end - z] * value(end - z, z) for z in range(1, min(LONGEST, end) + 1)))
        for start in range(n - 1, -1, -1):
            back[start] = sum(back[start + z] * value(start, z) for z in range(1, min(LONGEST, n - start) + 1))
        weight = counts[members] / fore[n]
        for (s, z), ids in spans.items():
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                np.add.at(uses, ids[hit], (fore[s] * value(s, z) * back[s + z] * weight)[hit])
    return uses


def fit_language(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation; the last entry is the floor."""
    found = pieces(path)
    prob = np.append(np.full(len(found.names), 1.0 / len(found.names)), FLOOR)
    for _ in range(rounds):
        uses = expected_uses(words, counts, prob, found)
        prob = uses + 0.01
        prob[-1] = 0
        prob /= prob.sum()
        prob[-1] = FLOOR
    return np.maximum(prob, FLOOR)


def _fitter(path: str, rounds: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        tally = Counter()
        for text in rows["text"]:
            tally.update(LETTERS.findall(text.lower()))
        prob = fit_language(list(tally), np.array(list(tally.values()), float), path, rounds)
        names = [*vocabulary(path), ""]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "piece": names, "prob": prob})

    return fit


def fit(docs: DataFrame, path: str = VOCABULARY, per_lang: int = PER_LANG, rounds: int = ROUNDS,
        text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``(lang, piece, prob)`` learned from labelled rows; the bound is ``per_lang`` documents of a language.

    The smallest hashes of each language are picked from narrow rows, combined per task
    first, so no language is gathered; texts are read for those alone.
    """
    ident = column(docs, id_col, "long")
    rows = docs.select(column(docs, lang_col, "string").alias("lang"), column(docs, text_col, "string").alias("text"), F.xxhash64(ident, F.lit(3)).alias("h"))
    rows = rows.filter("lang is not null and text is not null")
    some = rows.select("lang", "h", F.spark_partition_id().alias("task"))
    first = F.row_number().over(Window.partitionBy("lang", "task").orderBy("h"))
    some = some.withColumn("r", first).filter(F.col("r") <= per_lang)
    best = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    limit = some.withColumn("r", best).filter(F.col("r") <= per_lang).groupBy("lang").agg(F.max("h").alias("most"))
    picked = rows.join(F.broadcast(limit), "lang").filter(F.col("h") <= F.col("most")).select("lang", "text")
    return picked.groupBy("lang").applyInPandas(_fitter(path, rounds), "lang string, piece string, prob double")


class Model:
    """Piece probabilities as a matrix: bounded by the vocabulary times the number of languages."""

    def __init__(self, rows: pd.DataFrame, path: str):
        self.langs = sorted(rows["lang"].unique())
        names = [*vocabulary(path), ""]
        wide = rows.pivot(index="piece", columns="lang", values="prob") if len(rows) else pd.DataFrame(index=names)
        self.probs = wide.reindex(index=names, columns=self.langs).to_numpy(float)
        self.path, self.seen = path, {}

    def __reduce__(self):
        return _revive, (self.langs, self.probs, self.path)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        tallies = [Counter(LETTERS.findall(t.lower())) if t and self.langs else Counter() for t in texts]
        fresh = list({w for t in tallies for w in t if w not in self.seen})
        if len(self.seen) + len(fresh) > CACHE:
            self.seen = {}
            fresh = list({w for t in tallies for w in t})
        self.seen.update(zip(fresh, log_words(fresh, self.probs, pieces(self.path))))
        out = []
        for t in tallies:
            if not t:
                out.append(("und", 0.0))
                continue
            total = np.array(list(t.values()), float) @ np.array([self.seen[w] for w in t])
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def _revive(langs, probs, path):
    m = Model.__new__(Model)
    m.langs, m.probs, m.path, m.seen = langs, probs, path, {}
    return m


def model(docs: DataFrame, path: str = VOCABULARY, **options) -> Model:
    return Model(fit(docs, path, **options).toPandas(), path)


#: Texts scored together: a few MB of words, and one long text by itself.
TOGETHER = 256


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "__text"]
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = m.score(part.column(part.schema.get_field_index("__text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(n)) for n in rest], pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row, from its whole text only."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    rows = docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("__text"))
    return rows.mapInArrow(_scorer(shared), "id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, 4) == 2


def identified(docs: DataFrame, path: str = VOCABULARY, per_lang: int = PER_LANG, m: Model | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; learned only from rows that are not held out."""
    m = m or model(docs.filter(~held_out()), path, per_lang=per_lang)
    return predict(docs, m).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.5, path: str = VOCABULARY, per_lang: int = PER_LANG) -> DataFrame:
    """The documents in which a learned language is recognised with a posterior of at least ``least``."""
    m = model(docs.filter(~held_out()), path, per_lang=per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(m)
    rows = wrapped(docs)
    text = F.col("__row").getField("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.withColumn("__text", text).mapInArrow(_scorer(shared), schema)
    return unwrapped(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs.columns)
