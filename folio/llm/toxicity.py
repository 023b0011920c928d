"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters in lower case. Labels are of whole documents, so tokens are labelled
from them first: a word that is far commoner in toxic than in other labelled documents is toxic
wherever it stands in a toxic document, and every token of another document is not. A chain
of two states is fitted to those sequences (features: the word, its neighbours, the shape);
forward-backward gives every token's probability of being toxic. A document's score is a
logistic function, fitted on the document labels, of what the marginals add up to; runs of
tokens that are more likely toxic than not give the offending offsets.

Fitting reads a bounded sample (``SAMPLE`` labelled rows, those with the smallest hash of the
id) in tasks of about ``SHARD`` rows, whose weights are averaged. Scoring streams over batches; documents of a
batch step through the chain together, longest first.

Defined results: a text that is null or has no letters gets the score of a text without any
toxic evidence and no spans; without labelled rows every score is 0; repeated rows score alike;
labels that are null are not learned from, and if a document is labelled twice, the higher counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, crc_bucket, staged

#: Labelled rows that are fitted on, and about how many of them a task fits.
SAMPLE, SHARD = 6000, 1000
EPOCHS, RATE, RIDGE = 60, 0.5, 0.02
#: A word can be a feature from this many labelled documents on; the likelihood ratio of its share of toxic ones decides.
LEAST_DOCS = 3
#: A feature marks toxic tokens if so large a share of its documents is toxic.
SEED_SHARE = 0.6
TOKEN = re.compile(r"[^\W\d_]+")
#: Documents, and characters, that step through the chain together.
TOGETHER, CHARS = 2048, 8 << 20
#: In fitting, sequences are cut after so many tokens: what is learned is about neighbours.
PIECE = 64
SPANS = "array<struct<start:int,end:int>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


# ---- the chain


def _layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by length, longest first; where each begins; how many are active at each step."""
    sizes = np.array(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    longest = int(sizes[order[0]]) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    return order, starts, active


def marginals(score: np.ndarray, lengths: list[int], arcs: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state for each token, and of both a token and its forerunner being toxic.

    ``score`` is each token's log weight of being toxic; ``arcs`` the log weights of entering,
    leaving and staying in the toxic state. The forward and backward ratios (toxic to not) are
    kept instead of the sums, so nothing over- or underflows.
    """
    enter, leave, stay = (math.exp(min(30.0, max(-30.0, a))) for a in arcs)
    weight = np.exp(np.clip(score, -30, 30))
    fore, back = np.empty_like(weight), np.empty_like(weight)
    _, starts, active = _layout(lengths)
    ratio = None
    for t, n in enumerate(active):
        at = starts[:n] + t
        ratio = weight[at] if t == 0 else weight[at] * (enter + stay * ratio[:n]) / (1 + leave * ratio[:n])
        fore[at] = ratio
    ratio = np.zeros(0)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        now = np.ones(n)
        m = len(ratio)  # the documents that have a next token
        if m:
            nxt = ratio * weight[at[:m] + 1]
            now[:m] = (leave + stay * nxt) / (1 + enter * nxt)
        ratio = now
        back[at] = ratio
    odds = fore * back
    prob = odds / (1 + odds)
    first, _ = _ends(lengths, len(score))
    last = np.concatenate([[0.0], fore[:-1]])
    here = weight * back
    total = 1 + leave * last + enter * here + stay * last * here
    both = np.where(first, 0.0, stay * last * here / total)
    return prob, both


def emission(ids: np.ndarray, first: np.ndarray, last: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Log weight of the toxic state: the word's, its neighbours' (none across documents) and the bias."""
    out = w["word"][ids] + w["fixed"][0]
    before = np.where(first, 0.0, np.concatenate([[0.0], w["before"][ids[:-1]]])) if len(ids) else np.zeros(0)
    after = np.where(last, 0.0, np.concatenate([w["after"][ids[1:]], [0.0]])) if len(ids) else np.zeros(0)
    return out + before + after


def _ends(lengths: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    stops = np.cumsum([x for x in lengths if x])
    if len(stops):
        last[stops - 1] = True
        first[np.concatenate([[0], stops[:-1]])] = True
    return first, last


def fit_chain(docs: list[np.ndarray], truth: list[np.ndarray], n_words: int, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights by gradient ascent on the conditional likelihood (Adagrad steps, ridge penalty)."""
    lengths = [len(d) for d in docs]
    ids, gold = np.concatenate(docs), np.concatenate(truth).astype(float)
    first, last = _ends(lengths, len(ids))
    w = {"word": np.zeros(n_words), "before": np.zeros(n_words), "after": np.zeros(n_words), "fixed": np.zeros(4)}
    w["fixed"][0] = -2.0
    speed = {k: np.full_like(v, 1e-8) for k, v in w.items()}
    was = np.concatenate([[0.0], gold[:-1]]) * ~first
    for _ in range(epochs):
        prob, both = marginals(emission(ids, first, last, w), lengths, tuple(w["fixed"][1:]))
        off = gold - prob
        earlier = np.concatenate([[0.0], prob[:-1]]) * ~first
        here, there = gold * ~first, prob * ~first
        step = {
            "word": np.bincount(ids, off, n_words),
            "before": np.bincount(ids[:-1], (off * ~first)[1:], n_words), "after": np.bincount(ids[1:], (off * ~last)[:-1], n_words),
            "fixed": np.array([off.sum(), (here - here * was).sum() - (there - both).sum(),
                               (was * (1 - gold)).sum() - (earlier - both).sum(), (here * was).sum() - both.sum()])}
        for k in w:
            grad = step[k] - RIDGE * w[k]
            speed[k] += grad ** 2
            w[k] += RATE * grad / np.sqrt(speed[k])
    return w


class Model:
    def __init__(self, words: list[str], weights: dict[str, np.ndarray], logit: np.ndarray):
        self.words = {x: i for i, x in enumerate(words, start=1)}  # 0 is any other word
        self.weights, self.logit = weights, logit

    def ids(self, found: list[str]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(t, 0) for t in found), np.int64, len(found))

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """The toxic probability of every token of every text."""
        docs = [self.ids(tokens(t)) for t in texts]
        lengths = [len(d) for d in docs]
        ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        prob, _ = marginals(emission(ids, *_ends(lengths, len(ids)), self.weights), lengths, tuple(self.weights["fixed"][1:]))
        return np.split(prob, np.cumsum(lengths)[:-1]) if docs else []

    def score(self, prob: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-float(evidence(prob) @ self.logit))))


def evidence(prob: np.ndarray) -> np.ndarray:
    """What a document's marginals add up to: any toxic token, how many, and at which share."""
    if not len(prob):
        return np.array([1.0, 0.0, 0.0, 0.0])
    total = float(prob.sum())
    return np.array([1.0, float(1 - np.exp(np.log1p(-np.minimum(prob, 1 - 1e-9)).sum())), math.log1p(total), math.sqrt(total / len(prob))])


def fit_logit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
    return w


def spans(text: str, prob: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of runs of tokens with a probability of at least a half."""
    out, hot = [], prob >= 0.5
    if not hot.any():
        return out
    lowered = text.lower()
    if len(lowered) == len(text):
        found = [m.span() for m in TOKEN.finditer(lowered)]
    else:  # a few letters get longer in lower case; their offsets are mapped back
        back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        found = [(back[a], back[b - 1] + 1) for a, b in (m.span() for m in TOKEN.finditer("".join(c.lower() for c in text)))]
    run = None
    for at, on in zip(found, hot):
        if on:
            run = (run[0] if run else at[0], at[1])
        elif run:
            out.append({"start": run[0], "end": run[1]})
            run = None
    return [*out, {"start": run[0], "end": run[1]}] if run else out


# ---- as Spark jobs


def _fitter(words: list[str], seeds: set[str], epochs: int):
    index = {x: i for i, x in enumerate(words, start=1)}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        docs, truth = [], []
        for text, toxic in zip(rows["text"], rows["toxic"]):
            found = tokens(text)
            gold = np.array([toxic == 1 and t in seeds for t in found], bool)
            if not found or (toxic == 1 and not gold.any()):
                continue  # nothing in it says which tokens are meant
            ids = np.fromiter((index.get(t, 0) for t in found), np.int64, len(found))
            for at in range(0, len(ids), PIECE):
                docs.append(ids[at:at + PIECE])
                truth.append(gold[at:at + PIECE])
        if not docs:
            return pd.DataFrame({"part": [], "at": [], "value": []}).astype({"part": str, "at": int, "value": float})
        w = fit_chain(docs, truth, len(words) + 1, epochs)
        return pd.concat([pd.DataFrame({"part": k, "at": np.arange(len(v)), "value": v}) for k, v in w.items()])

    return fit


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(id, text, toxic)``: at most ``most`` labelled rows, by the smallest hash of the id.

    Of texts with the same least shingle hash one is left: copies of a document would make its words tell
    more than they do."""
    rows = labels.select(column(labels, "doc_id", "long").alias("id"), column(labels, "toxic", "int").alias("toxic")).dropna()
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = rows.orderBy(F.xxhash64(F.col("id"), F.lit(5))).limit(most)
    texts = docs.select(column(docs, "doc_id", "long").alias("id"), column(docs, "text", "string").alias("text"))
    found = texts.join(F.broadcast(some), "id").filter("text is not null")  # at most `most` narrow rows are sent
    words = F.split(F.lower("text"), r"\P{L}+")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 3)),
                           lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(3)]))
    found = found.withColumn("words", words).withColumn("family", F.array_min(shingles)).drop("words")
    return found.groupBy("family").agg(F.min(F.struct("id", "text", "toxic")).alias("r")).select("r.*")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, per_task: int = SHARD, epochs: int = EPOCHS) -> Model:
    """Learn from ``labels`` of ``docs``; give only rows that may be learned from. What reaches the driver is
    bounded by the sample: its words that tell toxic from other documents, the weights, and a few numbers for each row."""
    picked = staged(labelled(docs, labels, most), "labelled")
    base = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, n_toxic = base
    if not n_toxic or n_toxic == n:
        prior = -30.0 if not n_toxic else 30.0
        zero = {"word": np.zeros(1), "before": np.zeros(1), "after": np.zeros(1), "fixed": np.array([-30.0, 0, 0, 0])}
        return Model([], zero, np.array([prior, 0, 0, 0]))
    share = n_toxic / n
    words = picked.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))).alias("word"))
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("toxic")).filter(F.col("docs") >= LEAST_DOCS)
    seen = staged(seen, "words")
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(F.lit(0.0))
    clean = F.col("docs") - F.col("toxic")
    ratio = 2 * (part(F.col("toxic"), F.col("docs") * share) + part(clean, F.col("docs") * (1 - share)))
    bar = 2 * math.log(max(2, seen.count()))  # so that hardly any word gets over it by chance, however many are tested
    telling = seen.withColumn("ratio", ratio).filter(F.col("ratio") >= bar).orderBy("word").collect()
    names = [r["word"] for r in telling]
    seeds = {r["word"] for r in telling if r["toxic"] / r["docs"] >= SEED_SHARE}
    shard = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(max(1, round(n / per_task)))).alias("shard")
    parts = picked.select(shard, "text", "toxic").groupBy("shard").applyInPandas(_fitter(names, seeds, epochs), "part string, at long, value double")
    got = parts.groupBy("part", "at").agg(F.avg("value").alias("value")).toPandas()
    weights = {k: np.zeros(len(names) + 1) for k in ("word", "before", "after")} | {"fixed": np.array([-30.0, 0, 0, 0])}
    for k, rows in got.groupby("part"):
        weights[k] = np.zeros(len(weights[k]))
        weights[k][rows["at"].to_numpy()] = rows["value"].to_numpy()
    m = Model(names, weights, np.zeros(4))
    told = _run(picked.select("id", "text", "toxic"), m, ["toxic"]).select("toxic", "evidence").toPandas()
    m.logit = fit_logit(np.array(told["evidence"].tolist()), told["toxic"].to_numpy(float))
    return m


def slices(batch: pa.RecordBatch, at_text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``TOGETHER`` rows and about ``CHARS`` characters (a longer text is a part of its own)."""
    begin = held = 0
    for row, n in enumerate(pc.binary_length(batch.column(at_text)).to_pylist()):
        if row > begin and (held + (n or 0) > CHARS or row - begin >= TOGETHER):
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += n or 0
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _run(rows: DataFrame, m: Model, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            rest = [x for x in batch.schema.names if x != "text"]
            for part in slices(batch, at_text):
                texts = part.column(at_text).to_pylist()
                probs = model.tag(texts)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(part.schema.get_field_index(x)) for x in rest], pa.array([model.score(p) for p in probs], pa.float64()),
                    pa.array([evidence(p).tolist() for p in probs], pa.list_(pa.float64())),
                    pa.array([spans(t, p) if t else [] for t, p in zip(texts, probs)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=[*rest, "score", "evidence", "spans"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ["id", *keep])
    return rows.select("id", *keep, "text").mapInArrow(run, f"{kinds}, score double, evidence array<double>, spans {SPANS}")


def scored(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans`` from whole texts only."""
    rows = docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text"))
    return _run(rows, m, []).select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, 5) == 0


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, spans``; learned only from rows that are not held out."""
    m = fit(docs, labels.filter(~held_out()), most)
    return scored(docs, m).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
