"""Queries of the corpus operators against plain models of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wavespark.llm import canonical, encode, language, licenses, near, packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_the_library_s(name, spaced):
    path = encode.tokenizer_path(name)
    library, own = Tokenizer.from_file(path), encode.encoder(path, spaced)
    some = ["b <|endoftext|> c", "plain", "<|startoftext|>A b", "", " q  <|endoftext|>", "<|ENDOFTEXT|>", "plain <|endoftext|><|endoftext|>", "plain"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in some])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_query(spark, texts):
    library = Tokenizer.from_file(encode.tokenizer_path("word_bpe_49k.json"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for i, t in texts.items()}
    pieces, ends, sequences = packing.op4_packing(spark, SF).collect(), defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        ends[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans, total in [*((s, len(want[i])) for i, s in ends.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == total if total is not None else at <= 4096
    assert set(ends) == set(want)


def test_packing_takes_the_lowest_cost():
    r = random.Random(2)
    lengths = [r.randrange(1, 9000) for _ in range(300)]
    quadratic = 1 / 2048
    rest = sorted(((n % 4096, -i) for i, n in enumerate(lengths) if n % 4096), reverse=True)
    total = sum(n for n, _ in rest)
    room = [4096] * (total // 4096) + [1 << b for b in range(12, -1, -1) if total % 4096 >> b & 1]
    full, cost, want = list(room), [0.0] * len(room), []
    for n, i in rest:
        start = lengths[-i] - n
        while n:
            fits = [s for s in range(len(room)) if room[s] >= n]
            s = min(fits, key=lambda s: (cost[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            part = min(n, room[s])
            want.append((-i, start, part, s, full[s] - room[s]))
            room[s] -= part
            cost[s] += part + quadratic * part * part
            start, n = start + part, n - part
    own = sum(n // 4096 for n in lengths)
    got = packing.pack_lengths(lengths)
    assert [(i, a, n, s - own, at) for i, a, n, s, at in got if s >= own] == want


def _canonical(text: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def test_fingerprint_query_whole(spark, texts):
    rows = {r["doc_id"]: r for r in canonical.op8_document_fingerprints(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    prints = {}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        assert rows[a]["n_chars"] == len(texts[a]) and rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[a]["near_next"] == float(_canonical(texts[a]) == _canonical(texts[b]))
        assert rows[a]["near_edited"] == float(_canonical(texts[a]) == _canonical(edited))
        for text, fp in ((texts[a], rows[a]["fingerprint"]), (edited, rows[a]["edited_fingerprint"])):
            assert prints.setdefault(_canonical(text), fp) == fp
    assert len(set(prints.values())) == len(prints) and len(rows) == len(texts)


def test_fingerprint_query_of_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "one"), (3, "ONE "), (None, "none"), (9, "x" * 100_000)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = canonical.op8_document_fingerprints(spark, f"{tmp_path}/a").collect()
    fp = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    assert len(got) == len(rows) and fp[1, 0] == fp[2, 0] and fp[3, 3] == fp[3, 4] != fp[None, 4]
    spark.createDataFrame([], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert canonical.op8_document_fingerprints(spark, f"{tmp_path}/b").count() == 0


def test_signs_are_no_letters(spark):
    assert language.letters("½²") == [] and language.letters("a½b") == ["▁a", "▁b"] and toxicity.words_of("x²") == ["^x$"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in ((1, "² ½ ⅷ"), (2, "words"), (3, None))], "doc_id BIGINT, text STRING, lang STRING")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.learn(docs)).collect()}
    assert found == {1: "und", 2: "en", 3: "und"}


class _Plain:
    """Interpolated Kneser-Ney in dictionaries: counts below the highest order are of letters before, low orders are pooled."""

    def __init__(self, words, order=toxicity.ORDER, shared=toxicity.SHARED):
        self.n = [[Counter(), Counter()] for _ in range(order + 1)]
        for size in range(1, order + 1):
            for c in (0, 1):
                for w, k in words[c].items():
                    for i in range(len(w) - size + 1):
                        if size == order or i == 0:
                            self.n[size][c][w[i : i + size]] += k
                if size < order:
                    for g in {w[i : i + size + 1] for w in words[c] for i in range(len(w) - size)}:
                        self.n[size][c][g[1:]] += 1
            if size <= shared:
                self.n[size] = [self.n[size][0] + self.n[size][1]] * 2
        self.order = order

    def p(self, c, gram):
        if not gram:
            return 1 / 256
        some = {g: k for g, k in self.n[len(gram)][c].items() if g[:-1] == gram[:-1]}
        total, d = sum(some.values()), toxicity.DISCOUNT
        if not total:
            return self.p(c, gram[1:])
        return max(some.get(gram, 0) - d, 0) / total + sum(min(k, d) for k in some.values()) / total * self.p(c, gram[1:])

    def score(self, word):
        grams = [word[max(0, i + 1 - self.order) : i + 1] for i in range(1, len(word))]
        return sum(math.log(self.p(1, g) / self.p(0, g)) for g in grams)


def test_kneser_ney_is_brute_force():
    r = random.Random(1)
    some = lambda n: Counter("^" + "".join(r.choice("abcd") for _ in range(r.randrange(1, 8))) + "$" for _ in range(n))
    words = (some(60), some(40))
    plain = _Plain(words)
    own = toxicity.KneserNey(tuple(list(w) for w in words), tuple(np.array(list(w.values())) for w in words))
    asked = [*words[0], *words[1], *some(30), "^zz$", "^az$", "^$"]
    assert own.score(asked) == pytest.approx([plain.score(w) for w in asked], abs=1e-4)
    letters = [chr(i) for i in range(33, 289)]
    for context in ("", "^", "a", "^ab", "zz", "abcda"):
        for c in (0, 1):
            assert sum(plain.p(c, context + x) for x in letters) == pytest.approx(1)


def test_language_counts_are_brute_force():
    finder = language.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "▁ab"])
    probs = np.array([[0.1], [0.2], [0.15], [0.2], [0.15], [0.1], [0.1]])
    index = {p: i for i, p in enumerate(finder.pieces)}

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in index or k == 1:
                for rest in cuts(word[k:]):
                    yield [word[:k], *rest]

    words, counts = ["▁ab", "▁aba", "▁xab", "▁b"], np.array([2.0, 1.0, 3.0, 1.0])
    want, logs = np.zeros(len(index)), []
    for w, n in zip(words, counts, strict=True):
        ways = [(c, math.prod(probs[index[p], 0] if p in index else 1e-7 for p in c)) for c in cuts(w)]
        total = sum(x for _, x in ways)
        logs.append(math.log(total))
        for c, x in ways:
            for p in c:
                if p in index:
                    want[index[p]] += n * x / total
    assert finder.expected(words, counts, probs, 1e-7) == pytest.approx(want)
    assert finder.score(words, probs, 1e-7)[:, 0] == pytest.approx(logs)


@pytest.mark.parametrize("extra", [9, 40, 150])
def test_license_notices_in_parts(extra):
    index, mit = licenses.Index(licenses.TEMPLATES), licenses.TEMPLATES["MIT"].split()
    text = " ".join([*mit[:80], *["foo"] * extra, *mit[80:]])
    ((name, coverage, _, start, end),) = licenses.scan_text(index, text)
    assert (name, coverage, start, end) == ("MIT", 1.0, 0, len(text) - 1)
    assert licenses.scan_text(index, "Released under the BSD License.") == []
    twice = "Licensed under the Apache License, Version 2.0. Well. " * 2
    assert [(r[0], r[1]) for r in licenses.scan_text(index, twice)] == [("Apache-2.0-line", 1.0)] * 2


def test_winnow_keeps_one_gram_a_window():
    r = random.Random(4)
    words = [r.randrange(20) for _ in range(200)]
    for gram, window in ((3, 2), (4, 5), (2, 1)):
        kept = licenses.winnow(words, gram, window)
        places = {p for _, p in kept}
        assert all(tuple(words[p : p + gram]) == g for g, p in kept)
        for i in range(len(words) - gram - window + 2):
            hashes = [zlib.crc32(repr(tuple(words[k : k + gram])).encode()) for k in range(i, i + window)]
            best = max(k for k in range(window) if hashes[k] == min(hashes))
            assert i + best in places


def test_alignment_is_brute_force():
    r = random.Random(6)
    for _ in range(60):
        template, words = [[r.randrange(1, 5) for _ in range(r.randrange(1, 14))] for _ in range(2)]
        score = np.zeros((len(template) + 1, len(words) + 1))
        for i, t in enumerate(template, 1):
            for j, w in enumerate(words, 1):
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if t == w else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        matched, first, end, begin, last = licenses.align(template, words, -20, 20)
        # The spans found hold that many matches, and an alignment of them alone has the best score.
        assert matched <= min(end - first, last - begin) and (matched > 0) == (score.max() > 0)
        assert licenses.align(template[begin:last], words[first:end], -20, 20)[0] == matched
        gaps = max(end - first, last - begin)
        assert 2 * matched - (gaps - matched) >= score.max() - gaps and 2 * matched >= score.max()


def test_shingles_are_the_set_of_words_in_a_row(monkeypatch):
    r = random.Random(8)
    some = [" ".join(r.choice(["a", "B", "b", "cc", "é", "x" * 50]) for _ in range(n)) for n in (0, 1, 3, 5, 6, 40, 900)] + [" \t ", "a\x0bb\n\nc  d e f "]
    whole = [near.shingles(t.encode()) for t in some]
    for t, got in zip(some, whole, strict=True):
        w = t.encode().lower().split()
        want = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
    monkeypatch.setattr(near, "PIECE", 60)
    assert all((near.shingles(t.encode()) == got).all() for t, got in zip(some, whole, strict=True))


def test_sketches_bound_what_sets_have_apart():
    r = random.Random(9)
    for n in (0, 5, 300, 899, 901, 3000):
        base = {r.getrandbits(64) for _ in range(n)}
        for edits in (0, 1, 20, 400):
            other = set(sorted(base)[edits:]) | {r.getrandbits(64) for _ in range(edits)}
            a, b = (np.array(sorted(x), dtype=np.uint64) for x in (base, other))
            one, some = near.sketch(a), near.sketch(b)
            if len(one) >= len(some):
                assert near._least_apart(one, some[None])[0] <= len(base ^ other)
                assert len(one) != len(some) or (edits > 0 or near._least_apart(one, some[None])[0] == 0)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_cells_that_two_rows_have(size):
    r = random.Random(10)
    rows = sorted((r.randrange(30), r.choice([-1, -1, -1, 0]), k, 7) for k in range(60))
    batches = [pa.RecordBatch.from_pydict(dict(zip(["cell", "part", "id", "n"], map(list, zip(*rows[a : a + size], strict=True)), strict=True))) for a in range(0, len(rows), size)]
    got = [x["id"] for b in near._met(iter(batches)) for x in b.to_pylist()]
    met = [x[:2] for x in rows]
    assert got == [x[2] for x in rows if x[1] >= 0 or met.count(x[:2]) > 1]


def test_pairs_of_small_and_large_runs_agree(monkeypatch):
    r = random.Random(11)
    base = [{r.getrandbits(64) for _ in range(n)} for n in (1, 30, 890, 905, 1200)]
    sets = []
    for k in range(80):
        own = set(base[k % 5])
        for x in sorted(own)[: r.randrange(1 + len(own) // 6)]:
            own.discard(x)
            own.add(r.getrandbits(64))
        sets.append(np.array(sorted(own), dtype=np.uint64))
    rows = []
    for cell, blocks in enumerate([1, 1, 2, 3] * 3):
        for k in r.sample(range(80), r.choice([2, 9, 40])):
            block, root = k % blocks, k // 2
            rows += [(cell, min(block, o), max(block, o), len(sets[k]), block, k, root, near.sketch(sets[k]).tobytes()) for o in range(blocks)]
    rows.sort(key=lambda x: x[:3])
    names = ["cell", "i", "j", "n", "block", "id", "root", "sketch"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def found(size):
        parts = [zip(*rows[a : a + size], strict=True) for a in range(0, len(rows), size)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(p, types, strict=True)], names) for p in parts)
        return Counter((x["a"], x["b"], x["n"]) for b in near._cell_pairs(batches) for x in b.to_pylist())

    small = found(50)
    assert small == found(7) == found(10**6)
    monkeypatch.setattr(near, "FEW", 1)
    assert small == found(50)
    # No pair that is similar is missing, and none is within a class.
    met = {(min(x[5], y[5]), max(x[5], y[5])) for x in rows for y in rows if x[:3] == y[:3] and x[6] != y[6] and (x[1] == x[2] or x[4] != y[4])}
    pairs = {p[:2] for p in small}
    assert pairs <= met and {p for p in met if near.similar(sets[p[0]], sets[p[1]])} <= pairs


def test_a_group_gives_a_pair_once(monkeypatch):
    r = random.Random(12)
    none = np.zeros(0, dtype=np.uint64)
    base = [{r.getrandbits(64) for _ in range(n)} for n in (1, 30, 890, 905, 1200)]
    passage = {r.getrandbits(62) for _ in range(40)}
    sets = []
    for k in range(90):
        own = set(base[k % 5])
        for x in sorted(own)[: r.randrange(1 + len(own) // 6)]:
            own.discard(x)
            own.add(r.getrandbits(64))
        sets.append(np.array(sorted(own | passage if k % 3 else own), dtype=np.uint64))
    firsts = [near.firsts(x, none, none.astype(np.int64))[0].view(np.int64).tolist() for x in sets]
    rows = []
    for least, blocks in enumerate([1, 1, 2, 3]):
        for k in r.sample(range(90), r.choice([2, 40, 90])):
            block = k % blocks
            # A third of the cells is met in other groups.
            cells = firsts[k][least % 3 :: 3] if k % 2 else firsts[k]
            rows += [(least, min(block, o), max(block, o), len(sets[k]), block, k, k // 2, near.sketch(sets[k]).tobytes(), cells, len(firsts[k])) for o in range(blocks)]
    rows.sort(key=lambda x: x[:3])
    names = ["least", "i", "j", "n", "block", "id", "root", "sketch", "cells", "met"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def found(size):
        parts = [zip(*rows[a : a + size], strict=True) for a in range(0, len(rows), size)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(p, types, strict=True)], names) for p in parts)
        return Counter((x["a"], x["b"], x["n"], x["cells"]) for b in near._cell_pairs(batches) for x in b.to_pylist())

    want, similar = Counter(), Counter()
    for x, y in ((x, y) for x in rows for y in rows if x[:3] == y[:3] and x[5] < y[5] and x[6] != y[6] and (x[1] == x[2] or x[4] != y[4])):
        both, n = len(set(x[8]) & set(y[8])), min(x[3], y[3])
        row = (x[5], y[5], n, both)
        if both and both + min(x[9] - len(x[8]), y[9] - len(y[8])) >= near.shares_of(n):
            want[row] += 1
            similar[row] += near.similar(sets[x[5]], sets[y[5]])
    got = found(50)
    assert not got - want and not similar - got and sum(similar.values()) > 100
    assert sum(got.values()) < sum(row[3] * times for row, times in got.items()) / 10
    assert got == found(7) == found(10**6)
    monkeypatch.setattr(near, "LOOKED_UP", 10)
    assert got == found(50)
    monkeypatch.setattr(near, "FEW", 1)
    assert got == found(50)
