"""Main text where pages hold neither ``article`` nor ``main``."""

from __future__ import annotations

import re

import pytest

from folio.llm import htmltext


@pytest.mark.parametrize("share", [2, 1])
def test_text_of_div_layouts_is_read(spark, sf, share):
    """One page in two has its text in a div, then all pages."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    divs = lambda t: re.sub(r"</(article|main)>", "</div>", re.sub(r"<(article|main)\b", '<div class="content"', t))
    rows = [(i, u, divs(h) if k % share == 0 else h) for k, (i, u, h) in enumerate(pages)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = total = extra = 0
    for (i, _, h) in pages:
        inner = re.search(r"<article>(.*)</article>", h, re.S)
        want = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner.group(1))]
        want, have = [b for b in want if b], got[i].split("\n")
        total += sum(map(len, want))
        right += sum(len(b) for b in want if b in have)
        extra += sum(len(b) for b in have if b not in want)
    print(share, right / total, extra / total)
    assert right > 0.95 * total and extra < 0.05 * total
