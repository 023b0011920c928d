"""Exact language-model scores against a plain version."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import docs_of, none, odd  # noqa: F401

from folio.llm import lmexact, lmscore
from folio.llm import queries as Q


def plain_losses(docs, target):
    """``(id, words, target loss, background loss)`` from counts in dictionaries."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in docs]
    models = []
    for some in ([w for i, w in texts if i in target], [w for _, w in texts]):
        models.append([Counter(x for w in some for x in w), Counter(x for w in some for x in [None, *w][:-1] if w), Counter(x for w in some for x in zip([None, *w], w))])
    n = [sum(m[0].values()) for m in models]
    if not n[0]:
        models[0], n[0] = models[1], n[1]
    v, out = len(models[1][0]), []
    for i, w in texts:
        loss = []
        for (uni, ctx, pair), scale in zip(models, (1.0, n[0] / max(1, n[1]))):
            p = [(pair[a, b] * scale + lmscore.A * (uni[b] * scale + lmscore.B / v) / (n[0] + lmscore.B)) / (ctx[a] * scale + lmscore.A) for a, b in zip([None, *w], w)]
            assert all(x <= 1 for x in p)
            loss.append(-float(np.mean(np.log(p))) if w else 0.0)
        out.append((i, len(w), *loss))
    return out


def alike(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[1:]))
    got, want = sorted(((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("chunk", [50, lmexact.CHUNK])
def test_scores_equal_a_plain_version(spark, odd, none, chunk):  # noqa: F811
    target = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "id long")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    alike(lmexact.scored(odd, target, chunk).collect(), plain_losses(rows, set(range(0, 60, 3))))
    alike(lmexact.scored(odd, target.limit(0), chunk).collect(), plain_losses(rows, set()))
    assert lmexact.scored(none, target, chunk).count() == 0


def test_a_task_holds_one_part_at_a_time(spark, sf):
    """One task and 64 give the same scores; with rows in order of their parts each is answered before the next one comes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = docs.filter("doc_id % 3 = 0").select(docs["doc_id"].alias("id"))
    one, many = (lmexact.scored(docs, target, 5_000, tasks=n).collect() for n in (1, 64))
    alike(one, [(r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in many])
    chunks = [[{"part": p, "kind": kind, "chunk": c, "keys": lmexact.packed_keys(np.array([7 * p + 1, 7 * p + 2 + c], np.uint64)),
                "counts": lmexact.packed(np.ones((4 if kind == lmexact.WORDS else 2) * 2, np.int64))} for c in range(5)]
              for p in range(6) for kind in (lmexact.WORDS, lmexact.PAIRS)]
    read = []

    def batches():
        for k, rows in enumerate(chunks):
            read.append(k)
            yield pa.RecordBatch.from_pylist(rows, lmexact.ASKED_TYPES)

    for answer in lmexact._answerer(batches()):
        row = answer.to_pylist()[0]
        assert len(read) <= 2 * row["part"] + row["kind"] + 2, "later parts were read before this one was answered"
        counts = lmexact.unpacked(row["counts"], np.int64).reshape(4 if row["kind"] == lmexact.WORDS else 2, -1)
        assert counts[:, 0].tolist() == [5] * len(counts) and counts[:, 1].tolist() == [1] * len(counts)
    assert len(read) == 12


def test_query_keeps_words_apart_that_share_a_slot(spark, tmp_path):
    ids, first = lmscore.Ids(lmscore.VOCAB), {}
    for k in range(100_000):
        other = first.setdefault(ids[b"w%d" % k], k)
        if other != k:
            break
    one, two = f"w{other}", f"w{k}"
    texts = [f"a {one} b {one}"] * 12 + [f"a {two} b {two}"] * 12 + [f"a {one}", f"a {two}"]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    target = {r.id for r in lmscore.target_rows(labels).collect()}
    got = Q.QUERIES["op8_lm_score"](spark, str(tmp_path)).collect()
    alike(got, plain_losses(list(enumerate(texts)), target))
    score = {r.doc_id: r.score for r in got}
    assert score[24] > score[25] + 1
