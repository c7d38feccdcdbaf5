"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Words are runs of a-z and 0-9 in lower case. Of each window of WINDOW grams of GRAM words a
template keeps the gram of least hash; an inverted index has the templates and places of each kept
gram. Grams of a document that the index knows pick a template, a place and so a diagonal; hits of a
template whose diagonals and places lie together are a candidate. A local alignment within BAND words
of the hits' diagonals gives the matched words. Alignments of one template that follow each other in
text and template, as where words were put in between, are one match: its words' share of the template
is the coverage, and its first and last word in the document the span.

All of every text is scanned, in its own task; the index is as large as the templates.

Defined results: texts without matches, null and empty texts give no rows; a text gives a row for
each place that matches, and for each template that does; repeated rows give their rows again.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of
from .license_texts import TEMPLATES

GRAM = 3
WINDOW = 2
BAND = 8
#: The least coverage that is reported.
COVERAGE = 0.6
#: Templates of fewer words must be covered whole: a few words of a line are in any other line of its kind.
SHORT = 20
SCHEMA = "doc_id BIGINT, license STRING, coverage DOUBLE, matched_words INT, start BIGINT, end BIGINT"
_WORDS = re.compile(r"[a-z0-9]+")


def winnow(words: list[int], gram: int = GRAM, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(gram, place) of the least hash in each window of grams, the rightmost of equals."""
    grams = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)]
    hashes = [crc32(repr(g).encode()) for g in grams]
    kept = set()
    for i in range(max(1, len(grams) - window + 1)) if grams else ():
        kept.add(min(range(i, min(i + window, len(grams))), key=lambda k: (hashes[k], -k)))
    return [(grams[k], k) for k in sorted(kept)]


class Index:
    """The templates' vocabulary and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        found = {n: _WORDS.findall(templates[n].lower()) for n in self.names}
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for ws in found.values() for w in ws}))}
        self.words = {n: [self.ids[w] for w in found[n]] for n in self.names}
        self.base = len(self.ids) + 1
        posts: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for n in self.names:
            for gram, place in winnow(self.words[n]):
                posts[self.code(gram)].append((n, place))
        self.posts, self.codes = dict(posts), np.array(sorted(posts), dtype=np.int64)

    def code(self, gram: tuple[int, ...]) -> int:
        out = 0
        for w in gram:
            out = out * self.base + w
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(place, code) of the document's grams that the index knows."""
        if len(ids) < GRAM:
            return []
        code = np.zeros(len(ids) - GRAM + 1, dtype=np.int64)
        good = np.ones(len(code), dtype=bool)
        for k in range(GRAM):
            part = ids[k : k + len(code)]
            code = code * self.base + part
            good &= part > 0
        at = np.flatnonzero(good)
        at = at[np.isin(code[at], self.codes)]
        return list(zip(at.tolist(), code[at].tolist(), strict=True))


def align(template: list[int], words: list[int], low: int, high: int) -> tuple[int, int, int, int, int]:
    """(matched words, first, last + 1, the same of the template) of the best local alignment of words[j] and template[i], low <= j - i <= high.

    A match counts 2, a gap or a mismatch -1; of equal scores the earliest ending wins.
    """
    empty = (0, 0, 0, 0)  # score, matched, first, the template's first
    best, end, last = empty, 0, 0
    row: dict[int, tuple[int, int, int, int]] = {}
    for i, t in enumerate(template):
        new: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            score, matched, first, begin = row.get(j - 1, empty)
            if words[j] == t:
                cell = (score + 2, matched + 1, *((first, begin) if score > 0 else (j, i)))
            else:
                cell = (score - 1, matched, first, begin)
            for other in (row.get(j, empty), new.get(j - 1, empty)):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                new[j] = cell
                if cell[0] > best[0] or cell[0] == best[0] and j + 1 < end:
                    best, end, last = cell, j + 1, i + 1
        row = new
    return best[1], best[2], end, best[3], last


def groups(hits: list[tuple[int, int]], reach: int) -> list[list[tuple[int, int]]]:
    """Hits (place, diagonal) that belong together: diagonals within BAND of the least, then places within reach of the one before."""
    out: list[list[tuple[int, int]]] = []
    near: list[tuple[int, int]] = []
    for hit in [*sorted(hits, key=lambda h: (h[1], h[0])), (0, 1 << 60)]:
        if near and hit[1] - near[0][1] > BAND:
            near.sort()
            cuts = [k for k in range(1, len(near)) if near[k][0] - near[k - 1][0] > reach]
            out += [near[x:y] for x, y in zip([0, *cuts], [*cuts, len(near)], strict=True)]
            near = []
        near.append(hit)
    return out


def chains(found: list[tuple[int, int, int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """(matched words, first, last + 1) of alignments that follow each other in text and template alike, heaviest first.

    An alignment joins one that ends at most reach words before it; each is part of one chain.
    """
    found = sorted(found, key=lambda x: (x[1], x[2], x[3]))
    total, before = [x[0] for x in found], [-1] * len(found)
    low = 0
    for k, (matched, first, _, begin, _) in enumerate(found):
        while found[low][1] < first - 3 * reach:  # an alignment is at most twice as long as its template
            low += 1
        for j in range(low, k):
            if found[j][2] <= first <= found[j][2] + reach and found[j][4] <= begin and total[j] + matched > total[k]:
                total[k], before[k] = total[j] + matched, j
    out, used = [], set()
    for k in sorted(range(len(found)), key=lambda k: (-total[k], k)):
        path, at = [], k
        while at >= 0 and at not in used:
            path.append(at)
            at = before[at]
        used.update(path)
        if path:
            out.append((sum(found[x][0] for x in path), found[path[-1]][1], found[k][2]))
    return out


def scan_text(index: Index, text: str, least: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) with character places, in order of place and name."""
    lower = text.lower()
    if len(lower) != len(text):  # letters whose lower case is longer stay, so that places are the text's
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = _WORDS.findall(lower)
    get = index.ids.get
    ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
    hits = index.hits(ids)
    if not hits:
        return []
    by: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for at, code in hits:
        for name, place in index.posts[code]:
            by[name].append((at, at - place))
    out = []
    for name, places in by.items():
        template = index.words[name]
        size = len(template)
        aligned = []
        for group in groups(places, size):
            low, high = min(d for _, d in group) - BAND, max(d for _, d in group) + BAND
            # The group's places lie near each other; the template may begin a whole length before the first.
            a, b = max(0, group[0][0] - size - BAND), group[-1][0] + size + BAND
            matched, first, end, begin, last = align(template, ids[a:b].tolist(), low - a, high - a)
            aligned.append((matched, a + first, a + end, begin, last))
        for matched, first, end in chains(aligned, size):
            if matched >= (least if size >= SHORT else 1) * size:
                out.append((name, matched / size, matched, first, end))
    if not out:
        return []
    spans = [m.span() for m in _WORDS.finditer(lower)]
    rows = {(name, share, matched, spans[a][0], spans[b - 1][1]) for name, share, matched, a, b in out}
    return sorted(rows, key=lambda r: (r[3], r[4], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The matches of all documents: SCHEMA."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(i.as_py(), *r) for i, t in zip(batch.column(0), batch.column(1), strict=True) for r in scan_text(index, t.as_py(), least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
