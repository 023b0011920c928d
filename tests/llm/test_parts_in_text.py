"""Forms, adverts, notices, asides and comments inside an article are no text; plain pages keep all of theirs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import htmltext
from folio.llm.dom import Page

FIRST, SECOND, THIRD = ("The river rose again in the night, and by morning the lower fields were under water.",
                        "Nobody in the village had seen it so high since the bridge was built, forty years ago.",
                        "By noon the rain had stopped; the council met in the school and sent for boats.")
OFF = {
    "form": '<form action="/n"><p>Sign up for our letter now</p><input name="m"><button>Go</button></form>',
    "advert": '<div class="advert"><p>Buy cheap boots at the old mill today</p></div>',
    "ad": '<div class="ad">Buy cheap boots at the old mill today.</div>',
    "comments": '<article class="comment"><p>I was there and it was much worse than that, believe me.</p></article>'
                '<article class="comment"><b>Ann</b><p>Nonsense, the bridge is older.</p></article>',
    "section": '<section class="comments"><h3>Two replies</h3><div class="comment"><p>I was there too and saw the boats come.</p></div></section>',
    "aside": "<aside><h3>More</h3><p>Read what we wrote about the bridge in spring.</p></aside>",
    "notice": '<div class="cookie-notice"><p>This site stores cookies on your device.</p></div>',
}
AROUND = ('<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>{}'
          "<footer><p>Imprint and more</p></footer></body></html>")


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def trees(request, spark):
    return htmltext.model(spark.read.parquet(f"/root/testdata/{request.param}/pages.parquet"))


@pytest.mark.parametrize("kind", sorted(OFF))
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_other_parts_inside_the_text_go(trees, kind, shell):
    want = "\n".join((FIRST, SECOND, THIRD))
    for at in (1, 2, 3):
        parts = [f"<p>{t}</p>" for t in (FIRST, SECOND, THIRD)]
        parts.insert(at, OFF[kind])
        assert htmltext.texts([AROUND.format(shell.format("".join(parts)))], trees) == [want], at


def test_plain_pages_keep_their_text(trees):
    body = "".join(f"<p>{t}</p>" for t in (FIRST, SECOND, THIRD))
    for page in (AROUND.format(f"<article>{body}</article>"), AROUND.format(f"<div><div>{body}</div></div>"), AROUND.format(f'<div class="x1">{body}</div>')):
        assert htmltext.texts([page], trees) == ["\n".join((FIRST, SECOND, THIRD))]


def test_unsaid_parts_are_not_taught():
    page = Page(AROUND.format(f'<article><p>{FIRST}</p>{OFF["form"]}{OFF["comments"]}</article><article class="comment"><p>{SECOND}</p></article>'))
    _, label = htmltext.taught(page)
    said = {t: label[i] for i, t in page.blocks}
    assert said[FIRST] == 1 and said["Home"] == 0 and said["Sign up for our letter now"] == -1
    assert said[SECOND] == -1 and said["Nonsense, the bridge is older."] == -1


def test_decoding_equals_all_labellings():
    """The best of all labellings in which nothing inside a discarded element is kept, by enumeration."""
    rng = np.random.default_rng(3)
    page = Page("<div><p>a b c</p><div><p>d</p><p>e f</p></div></div><ul><li>g h</li><li>i</li></ul>")
    own = np.zeros(len(page.nodes))
    for i, t in page.blocks:
        own[i] += len(t.split())
    for _ in range(30):
        logit = rng.normal(0, 2, len(page.nodes))
        gain = np.clip(logit, -8, 8) * np.where(own > 0, 1 + np.log1p(own), htmltext.LIGHT)
        best = max((k for k in itertools.product((0, 1), repeat=len(own) - 1)
                    if all(not k[i - 1] or page.nodes[i].parent == 0 or k[page.nodes[i].parent - 1] for i in range(1, len(own)))),
                   key=lambda k: (np.dot(k, gain[1:]), -sum(k)))
        assert htmltext.kept(page, logit)[1:].tolist() == [bool(x) for x in best]


def test_sample_is_the_smallest_by_any_threshold(spark):
    rows = spark.range(5_000).select(F.xxhash64("id").alias("h"), F.lit(0).cast("long").alias("g"))
    want = sorted((r.h, 0) for r in rows.collect())
    assert htmltext.smallest(rows, 20) == want[:20]
    one = spark.range(100_000).select(F.xxhash64(F.lit(7)).alias("h"), F.lit(1).cast("long").alias("g"))
    assert len(htmltext.smallest(one, 20)) == 1  # one page repeated
    assert htmltext.smallest(rows.limit(0), 20) == []


def test_long_pages_and_clashing_columns(spark, trees):
    body = "".join(f"<p>{FIRST} {k}</p>" for k in range(20_000))
    page = AROUND.format(f"<article>{body}</article>")
    docs = spark.createDataFrame([(1, "u", page, 7, "x")], "page_id long, url string, html string, n_chars int, text string")
    row = htmltext.extracted(docs, trees).collect()[0]
    assert row.text.count("\n") == 19_999 and row.n_chars == len(row.text)
