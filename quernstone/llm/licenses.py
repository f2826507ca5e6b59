"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

A shared run of GRAM + WINDOW - 1 words always shares a fingerprint. Notices of up to NOTICE words have edits too close together
for that: each has as many anchors, single words, as a match may miss, and one more, so every match has one. Fingerprints of a document that the index knows give
places of templates; places that agree within the band are one candidate, which is aligned word by word inside the band.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernstone.llm.license_templates import TEMPLATES
from quernstone.llm.words import ALNUM_WORD, slices, words

GRAM, WINDOW = 3, 3
#: Words of the longest template that is found by single words.
NOTICE = 15
#: Least share of a template's words that a whole match covers, and one of which a part is left; width of the band on either side, as a share of the template.
COVERAGE, PARTIAL, SLACK, LEAST_BAND = 0.8, 0.3, 0.25, 4
#: The band of a long template, and the share of its fingerprints that a candidate shares at least: common legal phrases alone
#: are none. A template of fewer than 1 / LEAST_PRINTS fingerprints needs one.
MOST_BAND, LEAST_PRINTS = 128, 0.02
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Match(NamedTuple):
    license: str
    matched: int
    coverage: float
    start: int
    end: int


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _FACTOR
        out ^= out >> np.uint64(31)
    return out


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the selected hashes: in each window the least, the last of equal ones."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    w = min(WINDOW, len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(axis=1))


class Index:
    """Inverted index of the templates' fingerprints, anchors of notices, and words as numbers (0: no template has the word)."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> None:
        self.least = least
        self.names, self.ids, self.vocabulary = list(templates), [], {}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.prints: dict[int, int] = {}
        for t, text in enumerate(templates.values()):
            tokens = words(text.encode())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens], np.int64)
            self.ids.append(ids)
            if len(ids) <= NOTICE:
                missed = len(ids) - math.ceil(COVERAGE * len(ids) - 1e-9)
                # Long words are rarer; which are taken decides on speed only.
                for q in sorted(range(len(ids)), key=lambda q: -len(tokens[q]))[: missed + 1]:
                    self.anchors[int(ids[q])].append((t, q))
                continue
            hashes = gram_hashes(ids)
            for p in (own := winnowed(hashes).tolist()):
                self.postings[int(hashes[p])].append((t, p))
            self.prints[t] = len(own)
        self.known = np.array(sorted(self.postings), np.uint64)
        self.anchoring = np.isin(np.arange(len(self.vocabulary) + 1), list(self.anchors))

    def scan(self, tokens: list[bytes]) -> list[Match]:
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens], np.int64)
        if not ids.any():
            return []
        places: dict[int, list[int]] = defaultdict(list)
        if len(self.known):
            hashes = gram_hashes(ids)
            at = winnowed(hashes)
            at = at[self.known[np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)] == hashes[at]]
            for p in at.tolist():
                for t, q in self.postings[int(hashes[p])]:
                    places[t].append(p - q)
        found, parts = self.notices(ids)
        for t, offsets in places.items():
            template = self.ids[t]
            band = min(MOST_BAND, max(LEAST_BAND, int(SLACK * len(template))))
            offsets.sort()
            k = 0
            while k < len(offsets):
                first, last, begun = offsets[k], offsets[k], k
                while k < len(offsets) and offsets[k] - first <= band:
                    last, k = offsets[k], k + 1
                if k - begun < LEAST_PRINTS * self.prints[t]:
                    continue
                lo, hi = max(0, first - band), min(len(ids), last + len(template) + band)
                matched, start, end = aligned(template, ids[lo:hi], first - lo - band, last - first + 2 * band + 1)
                if matched < COVERAGE * len(template):
                    if self.counts(matched, len(template)):
                        parts.append((t, lo, hi, first - lo - band, last - first + 2 * band + 1))
                else:
                    found.append(Match(self.names[t], matched, matched / len(template), lo + start, lo + end))
        found = best(found)
        return sorted([*found, *self.partial(ids, found, parts)], key=lambda m: m.start) if parts else found

    def partial(self, ids: np.ndarray, found: list[Match], parts: list[tuple]) -> list[Match]:
        """Of candidates that no whole match came of, what words that no whole match covers make of them."""
        left = ids.copy()
        for m in found:
            left[m.start : m.end] = 0
        out = []
        for t, lo, hi, diagonal, width in parts:
            n = len(self.ids[t])
            matched, start, end = aligned(self.ids[t], left[lo:hi], diagonal, width)
            if self.counts(matched, n):
                out.append(Match(self.names[t], matched, matched / n, lo + start, lo + end))
        return best(out)

    def counts(self, matched: int, n: int) -> bool:
        """A part has GRAM words at least, as a fingerprint has."""
        return matched >= COVERAGE * n or matched >= max(GRAM, self.least * n)

    def notices(self, ids: np.ndarray) -> tuple[list[Match], list[tuple]]:
        """Matches, and candidates of parts, of templates of up to NOTICE words. A band can hold several, so each is looked for behind the one before."""
        places: dict[int, set[int]] = defaultdict(set)
        for p in np.flatnonzero(self.anchoring[ids]).tolist():
            for t, q in self.anchors[int(ids[p])]:
                places[t].add(p - q)
        found, parts = [], []
        for t, offsets in places.items():
            template, free = self.ids[t], 0
            n, band = len(template), max(LEAST_BAND, int(SLACK * len(template)))
            for first in sorted(offsets):
                lo, hi = max(free, first - band), min(len(ids), first + n + band)
                # Alignment is slow, and most places lack the words.
                if hi <= lo or not self.counts(int(np.isin(template, ids[lo:hi]).sum()), n):
                    continue
                matched, start, end = aligned(template, ids[lo:hi], first - lo - band, 2 * band + 1)
                if matched >= COVERAGE * n:
                    found.append(Match(self.names[t], matched, matched / n, lo + start, lo + end))
                    free = lo + end
                elif self.counts(matched, n):
                    parts.append((t, lo, hi, first - lo - band, 2 * band + 1))
        return found, parts


def aligned(template: np.ndarray, window: np.ndarray, diagonal: int, width: int) -> tuple[int, int, int]:
    """Most words of template in order in window, within the band of width diagonals from diagonal on, and their span.

    Cell (i, d) stands for template words before i and window words before i + diagonal + d.
    """
    n, m = len(template), len(window)
    table = np.zeros((n + 1, width), np.int32)
    for i in range(1, n + 1):
        j = np.arange(width) + i + diagonal  # window words so far
        inside = (j >= 1) & (j <= m)
        same = np.zeros(width, bool)
        same[inside] = window[j[inside] - 1] == template[i - 1]
        up = np.append(table[i - 1][1:], 0)
        table[i] = np.maximum.accumulate(np.maximum(up, table[i - 1] + same))
    d, i = int(table[n].argmax()), n
    matched, start, end = int(table[n][d]), 0, 0
    left = matched
    while left and i:
        j = i + diagonal + d
        if d and table[i][d - 1] == left:
            d -= 1
        elif d + 1 < width and table[i - 1][d + 1] == left:
            i, d = i - 1, d + 1
        else:
            end = end or j
            start, left, i = j - 1, left - 1, i - 1
    return matched, start, end


def best(found: list[Match]) -> list[Match]:
    """Of matches that overlap, those with most words, then the best covered, then the first by place and name."""
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (-m.matched, -m.coverage, m.start, m.license)):
        if all(m.end <= k.start or m.start >= k.end for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m.start)


_indexes: dict[tuple, Index] = {}


def index_of(templates: dict[str, str], least: float) -> Index:
    """The index of templates, built once per Python worker; only the last one is held."""
    key = (least, tuple(templates.items()))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(templates, least)
    return _indexes[key]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """One row per match: id_col, license, matched (words), coverage (of the template), start_word, end_word, start, end
    (characters), complete (coverage of COVERAGE at least).

    Matches that are not complete are given from a coverage of least and GRAM words on; no word counts for them that lies in a
    complete one.
    Texts without a match, without words, and null texts give no row; repeated rows give repeated results; a null id stays
    null. The templates' index is of the size of the templates. Other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("start_word", "end_word", "start", "end")], T.StructField("complete", T.BooleanType())])

    def run(batches):
        index = index_of(templates, least)
        for batch in slices(batches, 1):
            rows, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text and (found := index.scan(words(text.encode()))):
                    at = [m.span() for m in ALNUM_WORD.finditer(text)]
                    for m in found:
                        rows.append(k)
                        out.append((m.license, m.matched, m.coverage, m.start, m.end, at[m.start][0], at[m.end - 1][1], m.coverage >= COVERAGE))
            columns = list(zip(*out)) or [()] * 8
            types = (pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
