"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into shingles of ``K`` words; of every ``W`` neighbouring shingle hashes the
least is a fingerprint, and an inverted index maps fingerprints to templates and positions. The
same is done with every document. Any stretch of ``K + W - 1`` common words shares a
fingerprint, so no such stretch is missed. Templates below ``SHORT`` words are too short for
that: all their shingles are indexed and looked up at every place, so small that one survives
as many changed words as ``LEAST`` allows. Each diagonal on which a template is hit is a
candidate, and a local alignment within ``BAND`` words of it gives the share of the template
that is matched, and the characters it spans. The words that tell a license from its neighbours
(``NAMES``: name and version) have to be there as they are, whatever the share.

The templates are a fixed set, so the index a task holds does not grow with the documents;
documents are read once, nothing is shuffled, and a document of any length is hashed as an array.

Defined results: null, empty and wordless texts have no matches; repeated rows match alike; of
matches that overlap the one with the most words stays (then the higher coverage, then the
first name); all others are reported in order of place.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column
from folio.llm.templates import NAMES, TEMPLATES

K, W = 3, 3
#: Words an alignment may stray from its candidate's diagonal, and the least share of a template that counts.
BAND, LEAST = 12, 0.8
WORDS = re.compile(r"[A-Za-z0-9]+")
#: Templates with fewer words are looked up by all their shingles.
SHORT = 20
CACHE = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<license:string,coverage:double,start:int,end:int>>"


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str) -> list[str]:
    return " ".join(WORDS.findall(text)).lower().split()


def shingle_hashes(words: list[str], hashes: Hashes, k: int = K) -> np.ndarray:
    return shingled(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), k)


def shingled(ids: np.ndarray, k: int) -> np.ndarray:
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ ids[i:i + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def winnowed(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the fingerprints: the last least hash of each window."""
    n = len(hashes)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    view = sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(n - w + 1) + w - 1 - view.argmin(1))


def sure_run(n: int, least: float = LEAST) -> int:
    """Words that stay next to each other however the words that may differ in ``n`` lie, ``K`` at most."""
    differ = n - math.ceil(round(least * n, 6))
    return max(1, min(K, -(-(n - differ) // (differ + 1))))


def phrases_of(name: str, words: list[str]) -> list[list[str]]:
    """The phrases of ``NAMES`` that a template holds, in order of place."""
    text = f" {' '.join(words)} "
    found = [(text.index(f" {p} "), p.split()) for p in NAMES.get(name, ()) if f" {p} " in text]
    return [p for _, p in sorted(found)]


def named(phrases: list[list[str]], template: list[str], span: list[str], then: list[str]) -> bool:
    """Whether ``span`` holds the phrases in order; in a short template nothing may come between a phrase and the word
    after it, be that in ``span`` or in ``then``, the words that follow."""
    at = own = 0
    for p in phrases:
        k = len(p)
        own = next(i for i in range(own, len(template)) if template[i:i + k] == p) + k
        at = next((i for i in range(at, len(span) - k + 1) if span[i:i + k] == p), -1) + k
        if at < k:
            return False
        after = template[own:own + 1]
        rest = (span + then)[at:]
        if after and len(template) < SHORT and after[0] in rest[1:] and rest[0] != after[0]:
            return False
    return True


class Index:
    """Inverted index: fingerprint -> (template, position); of short templates every shingle."""

    def __init__(self, templates: dict[str, list[str]], k: int = K, w: int = W, least: float = LEAST):
        self.names, self.words, self.phrases = [], [], []
        short = defaultdict(lambda: defaultdict(list))
        self.k, self.w, found = k, w, defaultdict(list)
        hashes = Hashes()
        for name, texts in templates.items():
            for text in texts:
                words = words_of(text)
                t = len(self.names)
                self.names.append(name)
                self.words.append(words)
                self.phrases.append(phrases_of(name, words))
                if len(words) < SHORT:
                    size = sure_run(len(words), least)
                    for at, mark in enumerate(shingle_hashes(words, hashes, size)):
                        short[size][int(mark)].append((t, at))
                    continue
                marks = shingle_hashes(words, hashes, k)
                for at in winnowed(marks, w):
                    found[int(marks[at])].append((t, int(at)))
        self.places = dict(found)
        self.keys = np.sort(np.array(list(found), np.uint64))
        self.short = {size: (np.sort(np.array(list(places), np.uint64)), dict(places)) for size, places in short.items()}

    def hits(self, marks: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per template ``(diagonal, place in the document)``."""
        out = defaultdict(list)
        at = winnowed(marks, self.w)
        if not len(at) or not len(self.keys):
            return out
        near = np.minimum(np.searchsorted(self.keys, marks[at]), len(self.keys) - 1)
        for place in at[self.keys[near] == marks[at]]:
            for t, own in self.places[int(marks[place])]:
                out[t].append((int(place) - own, int(place)))
        return out


    def short_hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The same for short templates, from the hashes of a document's words."""
        out = defaultdict(list)
        for size, (keys, places) in self.short.items():
            marks = shingled(ids, size)
            near = np.minimum(np.searchsorted(keys, marks), len(keys) - 1)
            for place in np.flatnonzero(keys[near] == marks).tolist():
                for t, own in places[int(marks[place])]:
                    out[t].append((place - own, place))
        return out


def aligned(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment near a diagonal: words matched, first and last document word (2 for a match, -1 for a gap or a difference)."""
    best, wide = (0, 0, 0, -1), 2 * band + 1
    above = [(0, 0, -1)] * (wide + 2)  # score, matched words, first word; cell c is document word i + diagonal + c - 1 - band
    for i, want in enumerate(template):
        row, left = [(0, 0, -1)] * (wide + 2), (0, 0, -1)
        for c in range(1, wide + 1):
            j = i + diagonal + c - 1 - band
            if 0 <= j < len(words):
                score, matched, first = above[c]
                if words[j] == want:
                    cell = (score + 2, matched + 1, first if score > 0 else j)
                else:
                    cell = (score - 1, matched, first)
                skip = above[c + 1]
                if skip[0] - 1 > cell[0]:
                    cell = (skip[0] - 1, skip[1], skip[2])
                if left[0] - 1 > cell[0]:
                    cell = (left[0] - 1, left[1], left[2])
                left = row[c] = cell if cell[0] > 0 else (0, 0, -1)
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j)
            else:
                left = (0, 0, -1)
        above = row
    return best[1], best[2], best[3]


def scan(text: str | None, index: Index, hashes: Hashes, band: int = BAND, least: float = LEAST) -> list[dict]:
    """All matches of one text, in order of place; of overlapping ones the best."""
    if not text:
        return []
    words = words_of(text)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hits = {**index.hits(shingled(ids, index.k)), **index.short_hits(ids)}
    found = {}
    for t, places in hits.items():
        own, free, phrases = index.words[t], list(words), index.phrases[t]
        tell = {w for p in phrases for w in p}
        for diagonal in sorted({d for d, _ in places}):
            if not tell.issubset(free[max(0, diagonal - band):max(0, diagonal + len(own) + band)]):
                continue
            n, first, last = aligned(own, free, diagonal, band)
            if n >= least * len(own) and named(phrases, own, words[first:last + 1], words[last + 1:last + 1 + K]):
                found.setdefault(index.names[t], set()).add((n / len(own), first, last, n))
                free[first:last + 1] = [""] * (last + 1 - first)  # the next diagonal looks for another place
    if not found:
        return []
    spots = [m.span() for m in WORDS.finditer(text)]
    out, taken = [], []
    ways = [(-n, -coverage, name, first, last) for name, some in found.items() for coverage, first, last, n in some]
    for _, coverage, name, first, last in sorted(ways):
        if all(last < a or first > b for a, b in taken):
            taken.append((first, last))
            out.append({"license": name, "coverage": round(-coverage, 6), "start": spots[first][0], "end": spots[last][1]})
    return sorted(out, key=lambda m: (m["start"], m["license"], -m["coverage"]))


def _scanner(templates: dict[str, list[str]], band: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(templates, least=least), Hashes()
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [scan(t.as_py(), index, hashes, band, least) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return run


def licensed(docs: DataFrame, templates: dict[str, list[str]] | None = None, band: int = BAND, least: float = LEAST,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_matches, licenses, coverage`` (the highest, 0 if none) and ``matches``."""
    rows = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    found = rows.mapInArrow(_scanner(TEMPLATES if templates is None else templates, band, least), f"doc_id long, matches {MATCH}")
    return found.select("doc_id", F.size("matches").alias("n_matches"), F.array_sort(F.array_distinct("matches.license")).alias("licenses"),
                        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"), "matches")
