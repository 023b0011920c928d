"""Exact top-k search, the prefix trie and ranked lexical search against plain versions, on small tables with odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import maxscore, ranking, trie
from folio.llm import queries as Q

# ---- exact top-k search


def plain_top(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q is None or q % 20:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in ok if i != q)[:k]
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(found, 1)]
    return out


def as_rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, list(rows[40][1])) for i in range(60)]  # ties
    rows += [(rows[i][0], list(rows[i][1])) for i in (0, 20, 33)]  # repeated rows, two of them queries
    rows += [(None, list(rows[20][1])), (None, [0.5] * 12), (2000, None), (2020, [0.1, None, 0.2]), (2040, [float("nan")] * 12), (2060, [float("inf"), 0.0]),
             (2080, []), (2100, [-1.0, 2.0]), (-40, [0.25] * 30), (2120, [0.0] * 12), (2140, [-x for x in rows[40][1]])]
    return rows


@pytest.mark.parametrize("shard, block, group", [(maxscore.SHARD, maxscore.BLOCK, 4), (30 * 20, 30 * 3, 2), (30 * 300, 30, 1)])
def test_top_equals_brute_force(spark, vectors, shard, block, group):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "uid": F.lit(1), "block": F.lit(0), "rank": F.lit(0)})
    got = as_rows(maxscore.top(df, shard=shard, block=block, group=group), "query_id", "rank", "vec_id", "score")
    assert ordered(got) == ordered(plain_top(vectors))


def test_top_of_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top(none).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert as_rows(maxscore.top(few).orderBy("rank"), "rank", "vec_id", "score") == [(1, 1, 64 * 128), (2, 2, -64 * 64)]
    assert maxscore.top(few.filter("vec_id > 0")).count() == 0


def test_huge_components_do_not_crash(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1e30]), (2, [3.0, 4.0]), (20, [0.0, 2.0])]
    got = maxscore.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.count() == 6


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 9), st.integers(1, 300))
def test_maxscore_drops_no_row_that_reaches(seed, n, dim, least):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(-9, 10, (n, dim)) * (rng.random((n, dim)) < 0.6)
    q = rng.integers(-9, 10, dim)
    rows, scores = maxscore.Shard(np.arange(n), np.zeros(n, bool), matrix).reaching(q, least)
    exact = matrix @ q
    assert (scores == exact[rows]).all()
    assert set(np.flatnonzero(exact >= least)) == set(rows[scores >= least])


def test_maxscore_probes_fewer_rows_than_there_are():
    rng = np.random.default_rng(1)
    matrix = (rng.gamma(0.3, 6, (4000, 64)).astype(int)) * rng.choice([-1, 1], (4000, 64))
    shard = maxscore.Shard(np.arange(4000), np.zeros(4000, bool), matrix)
    q = matrix[7]
    least = int(np.sort(matrix @ q)[-20])
    rows, _ = shard.reaching(q, least)
    assert len(rows) <= 40


# ---- prefix trie

TALKS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(math.fmod(c, 20))
        full[c] = own.get(first, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
        ends[tuple(full[c])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        own_saved = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own_saved
    return [(ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
            for p, ms in members.items()]


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    words = ["hi there", "go", "a b\tc", "", "x", "what  now", "é\n"]
    rows = []
    for c in [*range(0, 90), -3, -20, 405]:
        if c == 20:
            continue
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    rows += [(500, t, "user", f"w{t % 3}") for t in range(150)]  # one chain
    rows += [(520 + k, t, "user", "same") for k in range(30) for t in range(5)]  # one large group
    rows += rows[:6]  # repeated rows
    rows += [(7, None, None, None), (7, None, "user", None), (8, 0, None, "x y"), (None, 0, "user", "lost"), (None, None, None, None), (600, 0, "user", "long " * 20_000)]
    return rows


@pytest.mark.parametrize("local, chunk, step", [(trie.LOCAL, trie.CHUNK, trie.STEP), (1, 2, 7), (25, 3, 1)])
def test_trie_equals_a_plain_one(spark, talks, monkeypatch, local, chunk, step):
    monkeypatch.setattr(trie, "STEP", step)
    df = spark.createDataFrame(talks, TALKS).withColumns({"depth": F.lit("x"), "conv": F.lit(1), "place": F.lit(2), "k1": F.lit(3)})
    got = as_rows(trie.prefix_trie(df, local=local, chunk=chunk), *NODE)
    assert ordered(got) == ordered(plain_trie(talks))


def test_empty_trie(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALKS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TALKS)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert as_rows(trie.prefix_trie(spark.createDataFrame(rows, TALKS)), *NODE) == plain_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.sampled_from([1, 3, 1000]))
def test_local_rounds_equal_plain_sums(seed, n, reach):
    rng = random.Random(seed)
    up = [0] + [max(0, i - rng.randint(1, reach)) for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    order = sorted(range(n), key=lambda i: depth[i])
    place = {x: i for i, x in enumerate(order)}
    up = np.array([place[up[x]] for x in order])
    weight, own = np.array([rng.randint(1, 9) for _ in range(n)]), np.array([[rng.randint(-5, 5) for _ in range(n)] for _ in range(2)])
    size, want = weight.copy(), own.copy()
    for i in range(n - 1, 0, -1):
        size[up[i]] += size[i]
        want[:, up[i]] += want[:, i]
    assert (trie._local(up, np.zeros(n, int), size, own) == want).all()


# ---- ranked search


def plain_ranking(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, m in held:
            m = 100 - 25 + 25 * m * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(split(text)).items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["alpha", "Beta", "été", "ÉTÉ", "x1", "42", "ø", "zeta", "eta", "iota", "K", "ſ", "\x85", "a b"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "-", "_", "..", "\x7f", "\x00"]) for _ in range(n))
    docs = [(i, prose(rng.randint(1, 40))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + docs[:5] + [(None, docs[3][1]), (900, None), (901, ""), (902, "-- !"), (903, prose(60_000))]
    items = [(i, prose(rng.randint(1, 12))) for i in range(30)] + [(30, None), (31, "  "), (0, "alpha"), (None, "beta 42"), (40, "nowhere"), (41, "alpha " * 3000), (42, prose(3000))]
    return docs, items


@pytest.mark.parametrize("items, columns, docs, block, heaviest, piece", [(256, 4096, 512, 8 << 20, ranking.HEAVIEST, 1 << 20), (7, 3, 9, 200, 40_000, 50)])
def test_ranking_equals_a_plain_one(spark, corpus, monkeypatch, items, columns, docs, block, heaviest, piece):
    for name, value in zip(("ITEMS", "COLUMNS", "DOCS", "HEAVIEST", "PIECE"), (items, columns, docs, heaviest, piece)):
        monkeypatch.setattr(ranking, name, value)
    more = {"score": F.lit("x"), "uid": F.lit(1), "rank": F.lit(2), "term": F.lit(3)}
    got = ranking.ranking(spark.createDataFrame(corpus[0], "doc_id long, text string").withColumns(more),
                          spark.createDataFrame(corpus[1], "item_id long, text string").withColumns(more | {"block": F.lit(0)}), block_bytes=block)
    assert ordered(as_rows(got, "item_id", "rank", "doc_id", "score")) == ordered(plain_ranking(*corpus))


def test_ranking_of_empty_tables(spark, corpus):
    docs, items = spark.createDataFrame(corpus[0], "doc_id long, text string"), spark.createDataFrame(corpus[1], "item_id long, text string")
    assert ranking.ranking(docs.limit(0), items).count() == 0
    assert ranking.ranking(docs, items.limit(0)).count() == 0
    assert ranking.ranking(docs.filter("text is null"), items).count() == 0


def test_no_partial_sum_reaches_2_53():
    block = ranking.Items([(0, b"a " * 5_000_000 + b"b c"), (1, b"b " * 10)])
    block.weigh(10**9, 10**12, {0: 1, 1: 5, 2: 10**8})
    for _, mats in block.tiles:
        for columns, m in mats:
            assert m.sum(axis=1).max() * ranking.IMPACT < 2**53
            assert len(columns) == m.shape[1]
    total = sum(m[0][columns == 0].sum() for _, mats in block.tiles for columns, m in mats)
    assert total == 5_000_000 * math.floor(1000 * math.log((2 * 10**9 + 2) / 3))


# ---- queries


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_prefix_trie", "op13_ranked_search"])
def test_query_equals_sql(spark, sf, name):
    from harness import compare, duck
    result, _, _ = compare(spark, duck(sf), name, Q.QUERIES[name], Q.ORACLES[name], sf)
    assert result.startswith("ok"), result


# ---- reading packages


def test_packages_are_read_in_more_than_one_task(spark, monkeypatch):
    from folio.llm import warc
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("text "), "id").alias("html"))
    manifest = warc.write(pages.repartition(40))
    assert manifest.count() >= 20
    read = warc.read(spark, manifest).withColumn("task", F.spark_partition_id())
    assert read.count() == 200 and read.select("page_id").distinct().count() == 200
    assert read.select("task").distinct().count() >= 10
