"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every element is scored from its own and its ancestors' tag and attribute words, depth,
subtree density of text, links and elements, and its place among its siblings. Decoding picks
the labelling of the whole tree with the highest score in which nothing inside a discarded
element is kept: a dynamic programme from the leaves up, then one pass down.

Fitting needs no labels by hand. From a bounded sample of pages (``SAMPLE``, those with the
smallest hash of the id) whatever lies in an ``article`` or ``main`` element is text and
whatever lies outside is not. What in such an element is a form, an aside or a menu, or is named
like an advert, a notice or a comment, says nothing (``unsaid``), and neither does an article
named like a comment. The same texts are set again in other page layouts (``LAYOUTS`` of each
page), which mark their parts and put adverts, forms, notices and comments inside the text too,
so that the trees learn more than one tag. A page with neither element says nothing about its
own parts: its nodes stay unlabelled, and its longer blocks only serve as text for other
layouts, so a table without such elements is read as well.

Defined results: null and empty html give an empty text; a page without any kept block gives
an empty text; broken and unclosed markup is read as far as it goes; a very long page is one tree
and read whole; repeated pages repeat in the result and count once in the sample; columns other
than id, address and html are left out, so none can clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import boost
from folio.llm.common import column
from folio.llm.dom import GROUPS, INLINE, Node, Page, features, group_bits

SAMPLE, LAYOUTS = 240, 2
#: Pages scored together.
TOGETHER = 64
#: Weight of an element without text of its own in decoding.
LIGHT = 0.25
#: Words of a block, at least, that serves as text for other layouts where a page is unlabelled.
LONG = 8


# ---- pages that mark their parts


def relaid(blocks: list[str], spare: list[str], rng: np.random.Generator) -> str:
    """The text ``blocks`` in a page layout of its own with menus, notices, adverts, forms and comments made of ``spare`` words."""
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda a, b: " ".join(pick(*spare) for _ in range(rng.integers(a, b)))
    sure = lambda *x: f'{pick("class", "class", "id")}="{pick(*x)}"'
    named = lambda *x: sure(*x) if rng.random() < 0.85 else f'class="c{rng.integers(1 << 16):x}"'
    links = lambda n, tag: "".join(f'<{tag}><a href="/{i}">{some(1, 4)}</a></{tag}>' for i in range(n))
    off = 'data-kind="off"'
    n = int(rng.integers(3, 12))
    menu = pick(f'<nav {off}><ul>{links(n, "li")}</ul></nav>', f'<div {off} {named("menu", "navbar", "main-nav")}>{links(n, "span")}</div>',
                f'<ul {off} {named("nav", "menu", "breadcrumbs")}>{links(n, "li")}</ul>')
    head = pick(f'<header {off}><h1>{some(1, 4)}</h1><p>{some(3, 9)}</p></header>', f'<div {off} {named("header", "masthead", "top-banner")}><div>{some(2, 8)}</div></div>', "")
    foot = pick(f'<footer {off}><p>&copy; {some(3, 15)}</p>{links(3, "span")}</footer>', f'<div {off} {named("footer", "site-footer", "copyright")}><p>{some(4, 20)}</p></div>')
    side = pick(f'<aside {off}><h3>{some(1, 4)}</h3><p>{some(8, 40)}</p></aside>', f'<div {off} {named("sidebar", "side-col", "widget", "related")}><h3>{some(1, 3)}</h3>'
                f'<ul>{links(n, "li")}</ul><p>{some(5, 40)}</p></div>', "")
    notice = pick(f'<div {off} {named("cookie-banner", "notice", "alert", "consent-popup")}><p>{some(6, 25)}</p><button>{some(1, 2)}</button></div>', "")
    form = pick(f'<form {off} action="/s"><label>{some(1, 3)}</label><input name="q"><select><option>{some(1, 2)}<option>{some(1, 2)}</select>'
                f'<button>{some(1, 2)}</button></form>', f'<div {off} {named("newsletter", "subscribe", "login")}><p>{some(4, 15)}</p><form><input></form></div>', "")
    advert = lambda: f'<{(t := pick("div", "section", "p", "aside"))} {off} {named("ad", "advert", "sponsored", "promo-box")}>{some(3, 30)}</{t}>' if rng.random() < 0.5 else ""
    talk = "".join(f'<{(t := pick("div", "li", "article"))} {named("comment", "reply")}><b>{some(1, 2)}</b><p>{some(4, 60)}</p></{t}>' for _ in range(rng.integers(1, 5)))
    talk = pick(f'<section {off} {named("comments", "responses", "discussion")}><h3>{some(1, 3)}</h3>{talk}</section>', "")
    share = pick(f'<div {off} {named("share", "social")}>{links(4, "span")}</div>', "")
    # within the text only a name or a tag tells such parts, never a place
    within = [lambda: f'<{(t := pick("div", "section", "p", "aside", "div"))} {off} {sure("ad", "advert", "ads", "sponsored", "promo-box", "advertisement")}>{inside(3, 30)}</{t}>',
              lambda: f'<form {off} action="/s">{inside(2, 12)}<input name="q"><button>{some(1, 2)}</button></form>',
              lambda: f'<div {off} {sure("newsletter", "subscribe", "signup")}>{inside(4, 15)}<form><input></form></div>',
              lambda: f'<{(t := pick("div", "p", "section"))} {off} {sure("notice", "alert", "cookie-banner", "disclaimer")}>{inside(4, 25)}</{t}>',
              lambda: f'<aside {off}>{inside(4, 40)}</aside>',
              lambda: f'<div {off} {sure("related", "sidebar", "widget", "recommended")}><h3>{some(1, 4)}</h3><ul>{links(n, "li")}</ul></div>',
              lambda: "".join(f'<{(t := pick("div", "article", "article"))} {off} {sure("comment", "reply", "reader-comment")}>{inside(4, 60)}</{t}>' for _ in range(rng.integers(1, 4)))]
    inside = lambda a, b: pick(*[f"<p>{some(a, b)}</p>"] * 3, some(a, b), f"<b>{some(1, 3)}</b><p>{some(a, b)}</p>")
    body = []
    for k, text in enumerate(blocks):
        tag = pick("p", "p", "p", "p", "li", "blockquote", "h2", "div") if len(text) < 400 else "p"
        body.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>")
        if rng.random() < 0.08:
            body.append(pick(*within)())
    title = f"<h1>{some(3, 9)}</h1>" if rng.random() < 0.7 else ""
    inner = title + "".join(body) + (pick(*within)() if rng.random() < 0.4 else "") + pick("", share) + pick("", talk)
    kind = 'data-kind="main"'
    text = pick(f"<article {kind}>{inner}</article>", f"<main {kind}>{inner}</main>", f'<div {kind} {named("content", "post", "entry-content", "article-body")}>{inner}</div>',
                f'<section {kind} {named("main", "story", "text")}><div>{inner}</div></section>')
    parts = [head, menu, notice, advert(), pick("", form)]
    rng.shuffle(parts)
    tail = [talk if "data-kind" in talk and talk not in inner else "", side, pick("", form), advert()]
    rng.shuffle(tail)
    middle = pick(f'{text}{"".join(tail)}', f'<div class="{pick("wrapper", "container", "row", "page")}">{side}{text}{"".join(x for x in tail if x != side)}</div>')
    return f'<!DOCTYPE html><html><head><title>x</title></head><body>{"".join(parts)}{middle}{foot}</body></html>'


#: Names of parts that may lie inside a text without belonging to it.
UNSAID = sum(1 << k for k, g in enumerate(GROUPS) if g in ("menu", "side", "ad", "notice", "form", "talk", "share"))


def unsaid(node: Node) -> bool:
    """Whether a node may be no text although an ``article`` or ``main`` holds it."""
    return node.tag in ("form", "aside", "nav", "footer", "dialog") or node.tag not in INLINE and bool(group_bits(node.words) & UNSAID)


def taught(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are labelled and how: by the nearest mark, or by ``article`` and ``main`` where a page has no marks;
    no node where it has neither. Elements around text count as text, because decoding has to pass through them."""
    nodes = page.nodes
    marked = any(x.marked for x in nodes)
    text = [x.tag in ("article", "main") and not unsaid(x) for x in nodes]
    label = np.full(len(nodes), 0 if not marked and any(text) else -1)
    for i, x in enumerate(nodes):
        above = label[x.parent] if i else label[0]
        if marked:
            own = {"main": 1, "off": 0}.get(x.marked or "", above)
        elif above == 1 and unsaid(x) or x.tag in ("article", "main") and not text[i]:
            own = -1
        else:
            own = 1 if text[i] and above == 0 else above
        label[i] = own
    for i in range(len(nodes) - 1, 0, -1):
        if label[i] == 1 and label[nodes[i].parent] != 1:
            label[nodes[i].parent] = 1
    return label >= 0, label


def fit(sources: list[str], layouts: int = LAYOUTS, seed: int = 11) -> boost.Trees | None:
    """Trees fitted on pages; None if they hold no element."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for source in sources:
        page = Page(source)
        _, label = known = taught(page)
        for p, (use, y) in [(page, known)] + [(q, taught(q)) for q in _others(page, label, layouts, rng)]:
            xs.append(features(p)[use])
            ys.append(y[use])
    if not xs or not any(len(x) for x in xs):
        return None
    return boost.fit(np.vstack(xs), np.concatenate(ys).astype(float))


def _others(page: Page, label: np.ndarray, layouts: int, rng: np.random.Generator) -> list[Page]:
    text = [t for i, t in page.blocks if label[i] == 1]
    if not (label >= 0).any():
        text = [t for _, t in page.blocks if len(t.split()) >= LONG] or [t for _, t in page.blocks]
    spare = [w for i, t in page.blocks for w in t.split()[:40] if label[i] != 1] + [w for t in text[:3] for w in t.split()[:40]]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    return [Page(relaid([escape(t) for t in text], [escape(w) for w in spare], rng)) for _ in range(layouts if text and spare else 0)]


# ---- reading


def kept(page: Page, logit: np.ndarray) -> np.ndarray:
    """The best labelling in which a kept element has only kept ancestors."""
    n = len(page.nodes)
    own = np.zeros(n)
    for i, text in page.blocks:
        own[i] += text.count(" ") + 1
    gain = np.clip(logit, -8, 8) * np.where(own > 0, 1 + np.log1p(own), LIGHT)
    best = gain.copy()  # of a subtree whose root is kept, against discarding all of it
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[page.nodes[i].parent] += best[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.nodes[i].parent] and best[i] > 0
    keep[0] = gain[0] > 0
    return keep


def texts(sources: list[str | None], trees: boost.Trees | None) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if trees is None:
        return ["" for _ in pages]
    rows = [features(p) for p in pages]
    logits = np.split(trees.logit(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    out = []
    for page, logit in zip(pages, logits):
        keep = kept(page, logit)
        out.append("\n".join(t for i, t in page.blocks if keep[i]))
    return out


def model(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS) -> boost.Trees | None:
    """Fit in one task on at most ``sample`` different pages; only their hashes and the trees reach the driver."""
    rows = pages.select(column(pages, "page_id", "long").alias("id"), column(pages, "html", "string").alias("html")).filter("html is not null and html <> ''")
    rows = rows.select("html", F.xxhash64(F.col("id"), F.lit(2)).alias("h"), F.xxhash64("html").alias("g"))
    chosen = smallest(rows.select("h", "g"), sample)
    if not chosen:
        return None
    some = rows.filter(F.col("h").isin([h for h, _ in chosen]) & F.col("g").isin([g for _, g in chosen])).dropDuplicates(["h", "g"]).orderBy("h", "g").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources = [s for b in batches for s in b["html"]]
        if sources:
            yield pd.DataFrame({"trees": [pickle.dumps(fit(sources, layouts))]})

    found = some.select("html").coalesce(1).mapInPandas(run, "trees binary").collect()
    return pickle.loads(found[0][0]) if found else None


def smallest(marks: DataFrame, most: int) -> list[tuple[int, int]]:
    """The ``most`` smallest different ``(h, g)``, by a threshold on the hash ``h`` that leaves few rows to sort.

    Where repeated rows leave too few below the threshold it is raised, until enough or all rows are read.
    """
    share = min(1.0, 4 * most / max(1, marks.count()))
    while True:
        low = marks if share >= 1 else marks.filter(F.col("h") < int(-(1 << 63) + share * (1 << 64)))
        found = [tuple(r) for r in low.distinct().orderBy("h", "g").limit(most).collect()]
        if len(found) == most or share >= 1:
            return found
        share = min(1.0, share * 16)


def extracted(pages: DataFrame, trees: boost.Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(column(pages, id_col, "long").alias("page_id"), column(pages, url_col, "string").alias("url"), column(pages, html_col, "string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return extracted(pages, model(pages, sample))
