"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import boost, decontam, exact, htmltext, langid, licenses, lmscore, mixing, simhash, toxicity, warc
from folio.llm import queries as Q
from folio.llm.common import ranked
from folio.llm.components import components
from folio.llm.dom import Page

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, sources=None, langs=None):
    n = len(texts)
    rows = [((ids or range(n))[i], t, (langs or ["en"] * n)[i], (sources or ["a"] * n)[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = ["alpha", "beta", "Gamma", "delta", "été", "x1", "omega", "zeta", "eta", "theta", "Über", "iota"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    texts = base + base[:8] + [base[3]] * 20 + [None, "", " \t\n", "  " + base[5].replace(" ", "\t\n") + " ", "12 --", prose(rng, 30_000)]
    ids = [*range(len(texts) - 2), None, 7]
    sources = [rng.choice(["a", "b", "é", None]) for _ in texts]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    once = docs_of(spark, texts, ids, sources, langs)
    return once.unionByName(once.limit(3)).withColumns({"key": F.lit(1), "id": F.lit("x"), "__rank": F.lit(None).cast("int"), "fp": F.lit(2), "size": F.lit(0), "copies": F.lit(9)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- shared helpers


def test_ranks_equal_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = {(r.g, r.v, r.k): r["__rank"] for r in ranked(df, ["g"], ["v", "k"]).collect()}
    for g in ("a", "b", None):
        own = sorted([r for r in rows if r[0] == g], key=lambda r: r[1:])
        assert [got[r] for r in own] == list(range(1, len(own) + 1))


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(1000, k) for k in range(1001, 1100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = components(spark.createDataFrame(pairs, "a long, b long").filter("a <> b"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 language ID


def segmentations(word, prob):
    """Brute force: every way to cut the word, floor for unknown letters."""
    def rest(w):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, len(w) + 1):
            p = prob.get(w[:n], langid.FLOOR if n == 1 else 0.0)
            total += p * rest(w[n:]) if p else 0.0
        return total
    return rest(langid.MARK + word)


def test_forward_sums_all_segmentations():
    found = langid.pieces(langid.VOCABULARY)
    rng = np.random.default_rng(1)
    prob = np.maximum(rng.random(len(found.names) + 1) / 1000, langid.FLOOR)
    prob[-1] = langid.FLOOR
    table = dict(zip(found.names, prob))
    words = ["the", "nation", "zeit", "a", "ñandú", "жx", "ingreat"]
    got = langid.log_words(words, np.column_stack([prob, prob]), found)
    assert np.allclose(got[:, 0], [np.log(segmentations(w, table)) for w in words])
    long = "nation" * 20
    assert np.allclose(langid._log_long(np.array([ord(c) for c in langid.MARK + long]), prob.reshape(-1, 1), found),
                       langid.log_words([long[:36]], prob.reshape(-1, 1), found)[0] * 120 / 36, rtol=0.05)


def test_expected_uses_are_posterior_counts():
    found = langid.pieces(langid.VOCABULARY)
    prob = np.append(np.full(len(found.names), 1e-3), langid.FLOOR)
    uses = langid.expected_uses(["the"], np.array([2.0]), prob, found)
    letters = sum(uses[found.index[p]] * len(p) for p in found.index if uses[found.index[p]] > 0)
    assert letters == pytest.approx(2 * 4)  # every way to cut covers the mark and three letters


def test_languages_are_told_apart_and_oddities_are_und(spark, odd, none):
    got = langid.identified(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert sorted(str(r.doc_id) for r in rows if r.lang_pred == "und") == ["68", "69", "70", "None"]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
    assert langid.identified(none).count() == 0
    kept = langid.recognised(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)


def test_language_accuracy_on_held_out_rows(spark, sf):
    got = Q.QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count()


# ---- 2 toxicity


def brute_marginals(score, arcs):
    import itertools
    import math
    total, one, two = 0.0, np.zeros(len(score)), np.zeros(len(score))
    for y in itertools.product((0, 1), repeat=len(score)):
        s = sum(a for a, b in zip(score, y) if b) + sum({(0, 1): arcs[0], (1, 0): arcs[1], (1, 1): arcs[2]}.get(p, 0) for p in zip(y, y[1:]))
        e = math.exp(s)
        total += e
        one += e * np.array(y)
        two[1:] += e * np.array([a and b for a, b in zip(y, y[1:])])
    return one / total, two / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths, arcs = [4, 0, 1, 7], (-0.5, 0.3, 1.2)
    score = rng.normal(size=sum(lengths))
    one, two = toxicity.marginals(score, lengths, arcs)
    at = 0
    for n in lengths:
        want = brute_marginals(score[at:at + n], arcs) if n else (np.zeros(0), np.zeros(0))
        assert np.allclose(one[at:at + n], want[0]) and np.allclose(two[at:at + n], want[1])
        at += n
    assert toxicity.marginals(np.zeros(0), [0, 0], arcs)[0].shape == (0,)


def test_toxic_documents_and_spans(spark, none):
    rng = random.Random(4)
    bad = ["vile", "filth"]
    texts, toxic = [], []
    for i in range(240):
        words = [rng.choice(["river", "stone", "cloud", "green", "walk", "paper", "song", "light"]) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(bad)
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    texts += [None, "", "123 !", "İstanbul VILE filth walk"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(0, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == len(texts)
    held = [i for i in range(240) if rows[i].held_out]
    assert sum(rows[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    for i in range(0, 240, 4):
        assert {w for s in rows[i].spans for w in texts[i][s.start:s.end].split()} <= set(bad)
    assert [texts[243][s.start:s.end] for s in rows[243].spans] == ["VILE filth"]
    assert rows[240].spans == [] and rows[240].score == rows[241].score == rows[242].score
    assert toxicity.toxicity(none, labels).count() == 0
    assert all(r.score < 0.5 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


# ---- 3 HTML


def test_tree_and_text_rules():
    page = Page("<p>a &amp; b<br>c\n  d<p>e<ul><li>f<li>g <b>h</b></ul><script>var t='</p>';</script><!-- x --><td>i</td>&eacute;")
    assert [t for _, t in page.blocks] == ["a & b c d", "e", "f", "g h", "i", "é"]
    assert [t for _, t in Page("<div>x<div>y</div>z").blocks] == ["x", "y", "z"]
    assert Page("").blocks == [] and Page("<p").blocks != None  # noqa: E711
    deep = Page("<div>" * 3000 + "x")
    assert len(deep.nodes) == 3001 and htmltext.features(deep).shape[0] == 3001


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((boost.fit(x, y, rounds=40).logit(x) > 0) == y).mean() > 0.97


def test_nothing_is_kept_inside_what_goes(spark):
    page = Page("<div><p>a b c</p><div><p>d</p></div></div>")
    for _ in range(50):
        logit = np.random.default_rng(_).normal(size=len(page.nodes)) * 3
        keep = htmltext.kept(page, logit)
        assert all(keep[x.parent] for i, x in enumerate(page.nodes) if x.parent > 0 and keep[i])  # the root only holds the others


def test_main_text_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9003, "u", "<p>"), (9003, "u", "<p>")], "page_id long, url string, html string")
    rows = htmltext.main_text(pages.unionByName(odd)).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == pages.count() + 4 and got[9001] == got[9002] == got[9003] == ""
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)
        want = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner.group(1))]
        assert got[p.page_id].split("\n") == [b for b in want if b]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_other_layouts_are_read_too(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect()]
    trees = htmltext.fit(pages[:40])
    rng, right, total = np.random.default_rng(99), 0, 0
    for source in pages[40:]:
        page = Page(source)
        _, label = htmltext.taught(page)
        for other in htmltext._others(page, label, 2, rng):
            _, want = htmltext.taught(other)
            keep = htmltext.kept(other, trees.logit(htmltext.features(other)))
            right += sum(len(t) for i, t in other.blocks if keep[i] == (want[i] == 1))
            total += sum(len(t) for _, t in other.blocks)
    assert right > 0.97 * total


# ---- 4 mixing


def test_mixing(spark, odd, none):
    rows = mixing.sampled(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(b[0].target for b in by.values()) == pytest.approx(total)
    for b in by.values():
        assert b[0].source_size == sum(r.size for r in b) and b[0].target <= 3 * b[0].source_size + 1e-6
        assert abs(sum(r.taken for r in b) - b[0].target) <= max(r.size for r in b)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in b)
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.sampled(odd.repartition(7)).collect()))
    copies = mixing.mixed(odd)
    assert copies.columns == [*odd.columns, "copy_no"] and copies.count() == sum(r.copies for r in rows)
    assert mixing.sampled(none).count() == 0 and mixing.mixed(none).count() == 0
    assert {r.taken for r in mixing.sampled(docs_of(spark, [None, ""])).collect()} == {0}


def test_excess_is_shared_again(spark):
    texts = ["w " * n for n in (1, 1, 400, 300, 2)]
    got = {r.source: r.target for r in mixing.sampled(docs_of(spark, texts, sources=["a", "b", "c", "d", None])).collect()}
    assert got["a"] == 3 and got["b"] == 3 and got[None] == 6  # weights 1, 2, 3, 1 and, for null, 2
    assert got["c"] == pytest.approx(3 * got["d"]) and sum(got.values()) == pytest.approx(704)


# ---- 5 exact dedup


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(squeezed(r.text), []).append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    for capacity in (exact.CAPACITY, 3):
        assert Counter(map(tuple, exact.duplicates(odd, capacity=capacity).collect())) == want
    one = exact.deduplicated(odd)
    assert one.columns == odd.columns and Counter(squeezed(r.text) for r in one.collect()) == Counter(groups.keys())
    assert {r.doc_id for r in one.collect()} == {min((i for i in ids if i is not None), default=None) for ids in groups.values()}
    assert exact.duplicates(none).count() == 0 and exact.deduplicated(none).columns == none.columns


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    slots, bits = exact.directory(keys, capacity=40)
    held = keys.withColumn("slot", F.expr(f"shiftrightunsigned(key, {64 - bits})")).join(slots, "slot").groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in held) == 2000 and max(r["count"] for r in held) <= 40 and len({r.depth for r in held}) > 1


# ---- 6 WARC


PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "u", "<p>é</p>"), (4, "u", None), (2, "u", ""), (8, "u", "x" * 300_000), (8, "u", "x" * 300_000),
            (None, "u", "only"), (None, "u", "<p>é</p>")]
    got = Counter(map(tuple, warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()))
    want = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        first = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        want[(page, len(body), warc.base32_sha1(body), "response" if page == first else "revisit", None if page == first else first)] += 1
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("limit", [None, 10])
def test_directories_are_read(tmp_path, monkeypatch, limit):
    if limit:  # makes the writer use ZIP64 fields for everything larger
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    data = {"a.txt": b"first", "é/b.bin": bytes(range(256)) * 9, "c": b""}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name, body in data.items():
            with z.open(name, "w", force_zip64=True) as f:
                f.write(body)
        z.writestr("packed", b"z" * 500, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 with the signature"
    with open(tmp_path / "x.zip", "rb") as f:
        members = warc.central_directory(f, (tmp_path / "x.zip").stat().st_size)
        assert set(members) == set(data)  # only stored members can be read by range
        for name, body in data.items():
            at, n = members[name]
            f.seek(at)
            assert f.read(n) == body


# ---- 7 SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(marks, bits=2):
    """Brute force over all pairs: mark -> smallest mark reachable."""
    marks = sorted(set(marks))
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if bin(a ^ b).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {m: find(m) for m in marks}


def test_near_duplicates(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    marks = [plain_fingerprint(r.text) for r in rows]
    roots = grouped(marks)
    least = {}
    for r, m in zip(rows, marks):
        if r.doc_id is not None:
            least[roots[m]] = min(least.get(roots[m], r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{m:016x}", least.get(roots[m])) for r, m in zip(rows, marks))
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == want
    one = simhash.without_near_duplicates(odd)
    without = {m for m in marks if roots[m] not in least}
    assert one.columns == odd.columns and Counter(r.doc_id for r in one.collect()) == Counter([*set(least.values()), *[None] * len(without)])
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [2, simhash.CROWD])
def test_no_link_is_lost(spark, crowd):
    rng = random.Random(6)
    marks = []
    for _ in range(30):
        m = rng.getrandbits(64)
        marks += [m, *(m ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)), m ^ 1 ^ (1 << 40) ^ (1 << 63)]
    marks += [(7 << 32) | x for x in range(200)] + [(x << 32) | 7 for x in range(200)]  # crowds
    signed = sorted({m - (1 << 64) if m >> 63 else m for m in marks})
    want = {(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2}
    got = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), crowd)
    assert {(r.a, r.b) for r in got.collect()} == want


# ---- 8 LM scoring


def test_counts_equal_a_plain_count(spark, odd):
    vocab, pairs = 16, 18
    marked = odd.filter("doc_id < 9").select(F.col("doc_id").alias("id")).distinct()
    got = {}
    for r in lmscore.counted(odd, marked, vocab, pairs).collect():
        for k, (t, b) in enumerate(zip(lmscore.unpacked(r.target), lmscore.unpacked(r.background))):
            if b:
                got[r.block * lmscore.BLOCK + k] = (t, b)
    want = {}
    for r in odd.select("doc_id", "text").collect():
        ids = lmscore.word_ids(r.text.encode() if r.text else None, lmscore.Ids(vocab))
        mark = r.doc_id is not None and r.doc_id < 9
        slots = [*ids, *([0, *ids[:-1]] + np.full(len(ids), 1 << vocab) if len(ids) else []), *(lmscore.pair_slots(ids, vocab, pairs) + (2 << vocab))]
        for s in slots:
            t, b = want.get(int(s), (0, 0))
            want[int(s)] = (t + mark, b + 1)
    assert got == want


def test_scores_follow_the_target(spark, none):
    rng = random.Random(8)
    good = [" ".join(rng.choice("river stone cloud walk song".split()) for _ in range(40)) for _ in range(60)]
    poor = [" ".join(rng.choice("click buy now free win".split()) for _ in range(40)) for _ in range(60)]
    docs = docs_of(spark, [*good, *poor, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, labels, 16, 18).collect()}
    held = [i for i in range(120) if rows[i].held_out]
    assert min(rows[i].score for i in held if i < 60) > max(rows[i].score for i in held if i >= 60)
    assert rows[120].score == rows[121].score == 0 and rows[120].n_words == 0
    assert lmscore.cross_entropy_difference(none, labels, 16, 18).count() == 0
    assert all(abs(r.score) < 1e-6 for r in lmscore.cross_entropy_difference(docs, labels.limit(0), 16, 18).collect())


def test_losses_are_those_of_the_formula():
    ids = lmscore.Ids(16)
    words = lmscore.word_ids(b"a b a b c", ids)
    slots = np.concatenate([words, np.concatenate([[0], words[:-1]]) + (1 << 16), lmscore.pair_slots(words, 16, 18) + (2 << 16)])
    n = np.bincount(slots, minlength=(2 << 16) + (1 << 18)).astype(np.float32)
    target, background = lmscore.Model(n, n, 16, 18).entropies(words)
    tokens, v = ["a", "b", "a", "b", "c"], 1 << 16
    uni = lambda w: (tokens.count(w) + lmscore.B / v) / (5 + lmscore.B)
    pairs = list(zip(["<s>", *tokens], tokens))
    ctx = Counter(p[0] for p in pairs)
    want = -np.mean([np.log((pairs.count(p) + lmscore.A * uni(p[1])) / (ctx[p[0]] + lmscore.A)) for p in pairs])
    assert target == pytest.approx(want, rel=1e-5) and background == pytest.approx(want, rel=1e-5)


# ---- 9 decontamination


def plain_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, window=10):
    out = Counter()
    for i, t in docs:
        ws, hit, found = plain_words(t), set(), set()
        for item, text in items:
            iw = plain_words(text)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[s:s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out[(i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_decontamination(spark, odd, none):
    rng = random.Random(9)
    texts = [r.text for r in odd.select("text").limit(30).collect()]
    items = [(10, " ".join(texts[0].split()[:12])), (2, texts[1]), (2, texts[1]), (3, "Über"), (4, "ALPHA beta"), (5, None), (6, " -- "), (7, prose(rng, 25)),
             (8, "ÜBER"), (9, "the the the the the the the the the the the"), (11, texts[4] + " . " + texts[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = docs_of(spark, ["The the THE the. the the the the the, the the the", "--über ÜBER Über", ",alpha,beta,"], [500, 501, 502])
    docs = odd.select(*extra.columns).unionByName(extra)
    want = plain_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    for block in (decontam.BLOCK, 5):
        got = decontam.contamination(docs, bench, block=block)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    clean = decontam.decontaminated(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == sum(n for k, n in plain_hits([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], items).items() if not k[5])
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


# ---- 10 license scans


def test_winnowing_meets_every_long_enough_stretch():
    rng = random.Random(3)
    template = [rng.choice(WORDS) for _ in range(60)]
    index = licenses.Index({"t": [" ".join(template)]})
    words = index.words[0]
    for _ in range(60):
        n, at = rng.randint(licenses.K + licenses.W - 1, 20), rng.randint(0, 40)
        doc = [f"q{rng.randint(0, 10 ** 6)}" for _ in range(30)] + words[at:at + n] + [f"q{rng.randint(0, 10 ** 6)}" for _ in range(30)]
        assert 0 in index.hits(licenses.shingle_hashes(doc, licenses.Hashes()))


def test_band_holds_the_best_alignment():
    rng = random.Random(4)
    for _ in range(30):
        template = [f"w{i}" for i in range(rng.randint(8, 40))]
        doc = list(template)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(doc))
            doc[at:at + rng.randint(0, 1)] = rng.choice([[], ["new"], ["new", "er"]])
        pre = [f"x{i}" for i in range(rng.randint(0, 30))]
        n, first, last = licenses.aligned(template, pre + doc + ["end"], len(pre))
        assert (n, first, last) == licenses.aligned(template, pre + doc + ["end"], 0, band=len(pre) + len(doc) + len(template))
        assert n >= sum(1 for w in doc if w.startswith("w")) - 2


def test_licenses(spark, odd, none):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    altered = apache.replace("You may obtain a copy", "You can get one copy")
    texts = ["Intro. Licensed under the Apache License, Version 2.0.\nRest", f"é İ head {altered} tail", "Released under the MIT License. x Released under the MIT License.",
             "This work is licensed under the GNU Affero General Public License, version 3.", None, "", "of the License the of", "licensed under the moon and stars"]
    rows = {r.doc_id: r for r in licenses.licensed(docs_of(spark, texts)).collect()}
    assert rows[0].licenses == ["Apache-2.0"] and texts[0][rows[0].matches[0].start:rows[0].matches[0].end] == "Licensed under the Apache License, Version 2.0"
    assert rows[1].licenses == ["Apache-2.0"] and 0.9 < rows[1].coverage < 1
    assert texts[1][rows[1].matches[0].start:].startswith("Licensed under") and rows[1].n_matches == 1
    assert rows[2].n_matches == 2 and rows[3].licenses == ["AGPL-3.0"]
    assert [rows[i].n_matches for i in (4, 5, 6, 7)] == [0, 0, 0, 0] and rows[4].coverage == 0
    assert licenses.licensed(odd).count() == odd.count() and licenses.licensed(none).count() == 0


def test_license_lines_of_the_table(spark, sf):
    lines = r"Licensed under CC BY-NC 4\.0\.|This work is licensed under the GNU General Public License, version 3\.|Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\."
    got = Q.QUERIES["op10_license_scan"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert got.filter(F.col("n_matches") != F.regexp_count("text", F.lit(lines))).count() == 0
