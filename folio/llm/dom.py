"""A small tolerant HTML tree: elements with their attribute words, and the blocks of text they hold."""

from __future__ import annotations

import html
import re

import numpy as np

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PART = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: Start tags before which an open element of the same kind ends, up to an element that keeps it in scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}


class Node:
    __slots__ = ("tag", "words", "marked", "parent", "depth", "pieces", "children", "n")

    def __init__(self, tag: str, words: frozenset[str], marked: str | None, parent: int, depth: int, n: int):
        self.tag, self.words, self.marked, self.parent, self.depth, self.n = tag, words, marked, parent, depth, n
        self.children: list[int] = []


class Page:
    """``nodes`` in page order (a parent before its children) and ``blocks``: (node, text) in page order."""

    def __init__(self, source: str):
        self.nodes = [Node("html", frozenset(), None, -1, 0, 0)]
        self.blocks: list[tuple[int, str]] = []
        self._open, self._text = [0], []
        self._holder = 0  # the block element that the gathered text is in
        self.links = [0]  # characters inside links, by node
        self._parse(source)
        self._flush()

    def _block_element(self) -> int:
        for i in reversed(self._open):
            if self.nodes[i].tag not in INLINE:
                return i
        return 0

    def _flush(self) -> None:
        if self._text:
            text = SPACES.sub(" ", html.unescape("".join(self._text))).strip()
            if text:
                self.blocks.append((self._holder, text))
            self._text = []
        self._holder = self._block_element()

    def _pop_to(self, depth: int) -> None:
        if any(self.nodes[i].tag not in INLINE for i in self._open[depth:]):
            self._flush()
            del self._open[depth:]
            self._holder = self._block_element()
        else:
            del self._open[depth:]

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for at in range(len(self._open) - 1, 0, -1):
            tag = self.nodes[self._open[at]].tag
            if tag in tags:
                self._pop_to(at)
                return
            if tag in scope:
                return

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            if found is None:
                self._add(source[at:])
                return
            if found.start() > at:
                self._add(source[at:found.start()])
            at = found.end()
            text = found.group()
            if text[1] in "!?":
                continue
            name = NAME.match(text).group(1).lower()
            if text[1] == "/":
                self._end(name)
            else:
                at = self._start(name, text, source, at)

    def _start(self, name: str, text: str, source: str, at: int) -> int:
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            if name not in INLINE and name not in ("script", "style", "template", "noscript"):
                self._flush()
            return stop.end() if stop else len(source) if not text.endswith("/>") else at
        if name in ("html", "head", "body") and name == "html":
            return at
        if name not in INLINE:
            self._close(("p",), ("button", "table", "td", "th", "object"))
            if name in CLOSES:
                self._close(CLOSES[name], SCOPE[name])
            self._flush()
        if name == "br":
            self._text.append(" ")
        if name in VOID or text.endswith("/>") and name in INLINE:
            return at
        words, marked = set(), None
        for key, value in ATTRIBUTE.findall(text[1 + len(name):-1]):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                words.update(PART.findall(value.lower()))
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                words.add("hidden")
            elif key == "data-kind":
                marked = value
        node = Node(name, frozenset(words), marked, self._open[-1], self.nodes[self._open[-1]].depth + 1, len(self.nodes))
        self.nodes[node.parent].children.append(node.n)
        self.nodes.append(node)
        self.links.append(0)
        self._open.append(node.n)
        if name not in INLINE:
            self._holder = node.n
        return at

    def _end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "br":
            self._text.append(" ")
            return
        for at in range(len(self._open) - 1, 0, -1):
            if self.nodes[self._open[at]].tag == name:
                self._pop_to(at)
                return

    def _add(self, text: str) -> None:
        if not self._text:
            self._holder = self._block_element()
        self._text.append(text)
        for i in reversed(self._open):
            if self.nodes[i].tag == "a":
                self.links[i] += len(text)
                break


# ---- features

#: Attribute words that tell what a part of a page is for, by group.
GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar skip toc",
    "head": "header masthead topbar banner logo branding hero",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar aside side rail widget widgets related recommended popular trending tags teaser more secondary complementary promo",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion dfp adsense outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice alert modal popup dialog overlay subscribe newsletter paywall disclaimer warning toast",
    "form": "form search login signup signin register input field contact captcha",
    "talk": "comment comments reply replies respond discussion disqus thread forum responses feedback reader",
    "share": "share sharing social follow facebook twitter byline author meta date timestamp",
    "main": "article content main post entry body story text page prose markdown blog news detail",
    "off": "hidden invisible",
}
WORD_GROUP = {}
for _g, (_name, _words) in enumerate(GROUPS.items()):
    for _w in _words.split():
        WORD_GROUP[_w] = WORD_GROUP.get(_w, 0) | 1 << _g
TAGS = ("nav header footer aside form button select fieldset script main article section div p h1 h2 h3 ul ol li table tr td figure "
        "figcaption blockquote pre address details dialog a span body").split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
N_GROUPS = len(GROUPS)
FEATURES = len(TAGS) + 2 * N_GROUPS + len(TAGS[:9]) + 17


def features(page: Page) -> np.ndarray:
    """A row of numbers for each node: its tag and attribute words, those above it, and the density of
    text, links and elements in its subtree, by itself and against its parent, siblings and the page."""
    nodes = page.nodes
    n = len(nodes)
    chars, words, marks, paragraphs, links = (np.zeros(n) for _ in range(5))
    for i, text in page.blocks:
        chars[i] += len(text)
        words[i] += text.count(" ") + 1
        marks[i] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        paragraphs[i] += 1
    links += page.links
    size = np.ones(n)
    parent = np.array([x.parent for x in nodes])
    for total in (chars, words, marks, paragraphs, links, size):
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
    depth = np.array([x.depth for x in nodes], float)
    group = np.array([group_bits(x.words) for x in nodes], np.int64)
    tag = np.array([TAG_AT.get(x.tag, -1) for x in nodes])
    above, above_tag = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, n):
        p = parent[i]
        above[i] = above[p] | group[p]
        above_tag[i] = above_tag[p] | (1 << tag[p] if 0 <= tag[p] < 9 else 0)
    order, brothers = np.zeros(n), np.ones(n)
    alike = np.zeros(n)
    for x in nodes:
        if x.children:
            total = words[x.children].sum()
            kinds = [nodes[c].tag for c in x.children]
            for k, c in enumerate(x.children):
                order[c], brothers[c] = k / len(x.children), len(x.children)
                alike[c] = words[c] / total if total else 0
            del kinds
    at_page = max(1.0, words[0])
    begin = np.zeros(n)
    run = 0.0
    own = np.zeros(n)
    for i, text in page.blocks:
        own[i] += text.count(" ") + 1
    for i in range(n):
        begin[i] = run / at_page
        run += own[i]
    one_hot = np.zeros((n, len(TAGS)))
    one_hot[np.flatnonzero(tag >= 0), tag[tag >= 0]] = 1
    bits = lambda v, k: (v[:, None] >> np.arange(k)) & 1
    up = parent.copy()
    up[0] = 0
    rest = np.column_stack([
        depth, np.log1p(words), np.log1p(chars), words / size, links / np.maximum(1, chars), marks / np.maximum(1, words), paragraphs / size,
        words / at_page, np.log1p(size), order, brothers, alike, np.log1p(words[up]), words / np.maximum(1, words[up]), begin,
        np.log1p(own), chars / np.maximum(1, words)])
    return np.hstack([one_hot, bits(group, N_GROUPS), bits(above, N_GROUPS), bits(above_tag, 9), rest])


def group_bits(words: frozenset[str]) -> int:
    """The groups of a node's attribute words, a bit each."""
    out = 0
    for w in words:
        out |= WORD_GROUP.get(w, 0)
    return out
