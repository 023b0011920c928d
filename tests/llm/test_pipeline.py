"""The pipeline against a plain version, and the queries against their SQL."""

from __future__ import annotations

from collections import Counter

import pytest
from harness import compare, duck
from test_operators import docs_of, grouped, plain_fingerprint, plain_hits, squeezed

import corpus_pipeline
from folio.llm import langid, mixing
from folio.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf, name):
    said, _, _ = compare(spark, duck(sf), name, Q.QUERIES[name], Q.ORACLES[name], sf)
    assert said.startswith("ok"), said


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{i}" for i in range(1, 14)}


def kept_by(docs, items):
    """Stages 2 to 4 in plain Python."""
    best = {}
    for i, t in docs:
        best[squeezed(t)] = min(best.get(squeezed(t), (i, t)), (i, t))
    one = sorted(best.values())
    roots = grouped([plain_fingerprint(t) for _, t in one])
    least = {}
    for i, t in one:
        r = roots[plain_fingerprint(t)]
        least[r] = min(least.get(r, i), i)
    one = [(i, t) for i, t in one if least[roots[plain_fingerprint(t)]] == i]
    dirty = {k[0] for k in plain_hits(one, items) if k[5]}
    return [(i, t) for i, t in one if i not in dirty]


def test_stages_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    first = corpus_pipeline.language(spark, docs, sf)
    told = {r.doc_id: r for r in langid.identified(docs).collect()}
    plain = [(i, t) for i, t in plain if told[i].lang_pred != "und" and told[i].score >= 0.5]
    assert {r.doc_id for r in first.select("doc_id").collect()} == {i for i, _ in plain}
    now = first
    for _, stage in corpus_pipeline.STAGES[1:4]:
        now = stage(spark, now, sf)
    want = kept_by(plain, items)
    assert now.columns == docs.columns and sorted(r.doc_id for r in now.select("doc_id").collect()) == [i for i, _ in want]
    copies = {r.doc_id: r.copies for r in mixing.sampled(now).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect())
    assert got == Counter({i: n for i, n in copies.items() if n})


def test_stages_take_odd_tables(spark, sf):
    odd = docs_of(spark, [None, "", "the same words here", "the same  words here", "short"], [1, 2, 3, 3, None]).withColumnRenamed("n_chars", "copy_no")
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            out.collect()
            if k < 4:
                assert out.columns == docs.columns
