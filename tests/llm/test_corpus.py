"""Corpus operators against brute force, and on rows that are null, empty, repeated or few."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from glob import glob

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavespark.llm import canonical, encode, exact, language, licenses, mixing, near, packing, queries, repeats, simhash, tokens, toxicity
from wavespark.llm.common import new_path
from wavespark.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, fp STRING, digest INT, id INT"


def table(spark, rows):
    """Documents of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 1, 2) for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (3, " \t ", "a"), (4, "one two  three", "b"), (4, "one two  three", "b"), (5, "one two\nthree", None), (6, "x" * 300_000, "a"), (None, "none here", "b"), (7, "É ﬁ İ", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- SQL ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a, b = queries.queries()[name](spark, SF).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    assert set(b.columns) <= set(a.columns)
    a, b = (x[sorted(b.columns)].sort_values("doc_id").reset_index(drop=True) for x in (a, b))
    assert (a.astype(str) == b.astype(str)).all().all()


# --- exact deduplication -----------------------------------------------------------------------


def test_exact_odd_rows(spark, odd, none):
    rows = exact.exact_dedup(odd).collect()
    assert len(rows) == len(ODD) and exact.exact_dedup(none).count() == 0
    kept = [r["doc_id"] for r in rows if r["kept"]]
    assert sorted(kept, key=lambda x: (x is not None, x)) == [None, 1, 3, 4, 6, 7]
    assert [r["kept"] for r in rows if r["doc_id"] == 4] in ([True, False], [False, True])
    assert {r["doc_id"]: r["keep_id"] for r in rows}[5] == 4


def test_index_remembers(spark):
    index = exact.DigestIndex(spark, buckets=4)
    index.assign(table(spark, [(10, "a b", "s"), (11, "c", "s")]))
    later = by_id(index.assign(table(spark, [(5, "a  b", "s"), (12, "d", "s")])))
    assert later[5]["keep_id"] == 10 and not later[5]["kept"] and later[12]["kept"]
    again = exact.DigestIndex(spark, index.path, buckets=4)
    assert again.table().count() == 3
    index.close()


# --- canonical digests -------------------------------------------------------------------------


def test_canonical_forms(spark):
    t = [(1, "Straße  É", ""), (2, " STRASSE\tÉ ", ""), (3, "ﬁ", ""), (4, "fi", ""), (5, "fi.", ""), (6, None, ""), (7, "", "")]
    fp = {r["doc_id"]: r["f"] for r in table(spark, t).select("doc_id", canonical.fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    assert fp[1] == fp[2] and fp[3] == fp[4] != fp[5] and fp[6] == fp[7] and all(len(v) == 32 for v in fp.values())
    rows = {r["class_id"]: r["class_size"] for r in canonical.classes(table(spark, t)).collect()}
    assert rows == {1: 2, 3: 2, 5: 1, 6: 2}


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_next_document(spark, ranges, none):
    ids = random.Random(1).sample(range(1000), 40)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r["next_value"] for r in canonical.with_next(df, "doc_id", "text", ranges).collect()}
    order = sorted(ids, reverse=True)
    assert found == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert canonical.with_next(none, "doc_id", "text").count() == 0


def test_fingerprint_query(spark, texts):
    rows = by_id(canonical.op8_document_fingerprints(spark, SF))
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        assert rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


# --- mixing ------------------------------------------------------------------------------------


def test_mix_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and mixing.mix(none).count() == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["target"] for r in {r["source"]: r for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_mix_hits_targets_and_prefers_quality(spark):
    docs = table(spark, [(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(600)])
    good = spark.createDataFrame([(i, 100.0) for i in range(0, 600, 2)], "doc_id BIGINT, weight DOUBLE")
    rows = mixing.mix(docs, weights=(1, 9, 9), quality=good, bins=8).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    part = [r for r in rows if r["source"] == "s0" and r["part"] > 0]
    assert sum(r["doc_id"] % 2 == 0 for r in part) > 0.8 * len(part)


def test_first_words(spark):
    df = spark.createDataFrame([(" a b\n\nc  d ", 3), ("a", 1), ("a b", 0)], "t STRING, n INT")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a b\n\nc", "a", ""]


# --- repeats -----------------------------------------------------------------------------------


def removed(rows, least):
    first, out = {}, {}
    texts = sorted({(i, (t or "").encode()) for i, t, _ in rows}, key=lambda x: (x[0] is None, x))
    for i, t in texts:
        for p in range(len(t) - least + 1):
            first.setdefault(t[p : p + least], i)
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] != i:
                gone[p : p + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [1, 2000])
def test_repeats_brute_force(spark, crowd):
    r = random.Random(crowd)
    words = ["alpha", "beta", "gamma", "delta", "é", "xx", "the", "of"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(9, None, ""), (8, "", ""), (7, "short", ""), (20, "z" * 500, ""), (21, "z" * 200, "")]
    for i in range(30, 70):
        a, b = r.sample(base, 2)
        rows.append((i, a[r.randrange(80) : r.randrange(100, 300)] + str(i) + b[: r.randrange(250)], ""))
    rows += [rows[10], (90, rows[10][1], "")]
    got = by_id(repeats.Repeats(table(spark, rows), crowd=crowd).removed())
    want = removed(rows, 50)
    assert {i: (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for i, g in got.items()} == want


def test_repeats_odd_rows(spark, odd, none):
    assert repeats.Repeats(odd).removed().count() == len(ODD)
    assert repeats.Repeats(none).removed().count() == 0


def test_maximal_repeats_have_all_members(spark):
    shared = " ".join(f"word{k}" for k in range(20))
    docs = table(spark, [(i, f"{i} start {shared} end {i}", "") for i in range(5)])
    r = repeats.Repeats(docs)
    sizes = r.members().groupBy("group").agg(F.countDistinct("id").alias("n"), F.min("length").alias("l")).collect()
    assert sizes and all(x["n"] == 5 and x["l"] >= 50 for x in sizes)


def test_interval_tree_is_that_of_the_strings():
    strings = [b"aXbanana" * 9, b"cXbanana" * 9, b"dXbanan" * 10]
    sa = repeats.SuffixArray(strings, np.ones(3, dtype=np.int64), 20)
    for i in range(1, len(sa.content)):
        a, b = (strings[sa.content[k]][sa.offset[k] :] for k in (i - 1, i))
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert sa.common[i] == n and a <= b
    tree = repeats.interval_tree(sa.common.tolist(), 20, sa.content.tolist(), sa.content.tolist(), sa.before.tolist())
    for size, a, b, lo, hi, _ in tree:
        members = {strings[sa.content[k]][sa.offset[k] : sa.offset[k] + size] for k in range(a, b + 1)}
        assert len(members) == 1 and lo == sa.content[a : b + 1].min() and hi == sa.content[a : b + 1].max()


# --- SimHash -----------------------------------------------------------------------------------


def test_fingerprint_of_whole_texts():
    text = "The quick BROWN fox\tjumps  é"
    w = text.replace("T", "t").replace("BROWN", "brown").split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    assert simhash.text_fingerprint(text.encode()) == want
    assert simhash.text_fingerprint(b" \n") == 0
    assert simhash.text_fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", 42)


@pytest.mark.parametrize("block", [3, 4096])
def test_links_lose_nothing(spark, block):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(5)]
    fps = {c ^ sum({1 << r.randrange(64) for _ in range(r.randrange(6))}) for c in centres for _ in range(40)} | {0, 1, 7, 15, 0xFFFFFFFFFFFFFFFF}
    fps = sorted(fps)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [root(i) for i in range(len(fps))]
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp BIGINT, id BIGINT")
    found = {x["vertex"]: x["root"] for x in components(simhash.links(points, 3, block)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_simhash_odd_rows(spark, odd, none):
    rows = simhash.near_classes(odd).collect()
    assert len(rows) == len(ODD) and simhash.near_classes(none).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[4] == 4 and by[None] is None


def test_components_of_a_path_and_a_star(spark, none):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)], "a BIGINT, b BIGINT")
    for small in (20, 1000):
        found = {r["vertex"]: r["root"] for r in components(e, small).collect()}
        assert all(v == (0 if k <= 60 else 100) for k, v in found.items()) and len(found) == 111
    assert components(e.limit(0)).count() == 0


# --- tokens and packing ------------------------------------------------------------------------

TRICKY = ["  a b", " a", "a ", "a\n\nb", "x\t y", " ", "", "\n", "é  b", "ÉTÉ. İx ʼN, don't! a.b, c.., 5,6 10.", "ＡＢ éa. ẞ&&&", "\nb <|endoftext|> c", "x" * 5000, "a b c", "THE!! 　 x"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoding_is_the_library_s(texts, name, spaced, monkeypatch):
    monkeypatch.setattr(encode, "ROOM", {True: 50, False: 50})
    e = encode.encoder(encode.tokenizer_path(name), spaced)
    some = TRICKY + list(texts.values())[:60]
    assert e.encode([t.encode() for t in some]) == e.whole(some) == e.encode([t.encode() for t in some])


def test_token_files(spark, texts, odd, none):
    rows = by_id(tokens.op9_token_output(spark, SF))
    e, at = encode.encoder(encode.tokenizer_path("byte_bpe_50k.json"), True), 0
    for i in sorted(texts):
        ids = np.array([*e.library.encode(texts[i], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = tokens.write_tokens(odd, new_path(spark, "t"))
    got = tokens.starts(tokens.read_tokens(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7] and got[1]["tokens"] == [0]
    assert tokens.read_tokens(spark, tokens.write_tokens(none, new_path(spark, "t"))).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 1], [5, 5, 5], [10_000, 3000, 2000, 900, 1], list(range(1, 400))])
def test_pack_lengths(lengths):
    pieces = packing.pack_lengths(lengths)
    for i, n in enumerate(lengths):
        own = sorted(p[1:3] for p in pieces if p[0] == i)
        assert [a for a, _ in own] == [sum(k for _, k in own[:j]) for j in range(len(own))] and sum(k for _, k in own) == n
    sizes: dict[int, list] = {}
    for _, _, n, s, at in pieces:
        sizes.setdefault(s, []).append((at, n))
    for got in sizes.values():
        got.sort()
        assert [a for a, _ in got] == [sum(k for _, k in got[:j]) for j in range(len(got))]
        total = sum(k for _, k in got)
        assert total <= 4096 and total & (total - 1) == 0  # nothing is padded


def test_pack_rows(spark, odd, none):
    rows = packing.pack(odd).collect()
    assert packing.pack(none).count() == 0 and {r["doc_id"] for r in rows} == {i for i, _, _ in ODD}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


# --- language and toxicity ---------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "ba", "aba"])
    probs = np.array([[0.1], [0.2], [0.3], [0.05], [0.01]])
    p = dict(zip(pieces.pieces, probs[:, 0], strict=True))

    def brute(w):
        return 1.0 if not w else sum(p.get(w[:k], 1e-7 if k == 1 else 0) * brute(w[k:]) for k in range(1, len(w) + 1))

    words = ["a", "aba", "abab", "bxa", "baab"]
    assert np.allclose(np.exp(pieces.score(words, probs, 1e-7)[:, 0]), [brute(w) for w in words])


def test_language_held_out(spark, small, odd, none):
    rows = by_id(language.op7_language(spark, SF))
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert sum(rows[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    model = language.learn(small)
    got = language.predict(odd, model).collect()
    assert len(got) == len(ODD) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3))
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.learn(none)).collect()} == {"und"}


def test_kneser_ney_probabilities_add_up():
    words = (["^abab$", "^abba$", "^cab$"], ["^idio$", "^abab$"])
    model = toxicity.KneserNey(words, (np.array([3, 1, 2]), np.array([4, 1])), order=4)
    assert model.score(["^idio$"])[0] > 1 > model.score(["^cab$"])[0]


def test_toxicity_rows(spark, odd, none):
    rows = by_id(toxicity.op5_toxicity(spark, SF))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    docs = table(spark, [(i, ("you vile zzgrub person " if i % 4 == 0 else "a plain kind sentence ") * 5, "") for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id BIGINT, toxic INT")
    model = toxicity.learn(docs, labels)
    got = by_id(toxicity.score(docs, model))
    assert all((r["score"] >= 0.7) == (i % 4 == 0) for i, r in got.items())
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}


# --- licenses ----------------------------------------------------------------------------------


def test_license_places():
    index = licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        text = f"Some words. {template} More words."
        found = {r[0]: r for r in licenses.scan_text(index, text)}
        assert found[name][1] == 1.0 and text[found[name][3] : found[name][4]].rstrip('.",/') == template.rstrip('.",/')
    mit = licenses.TEMPLATES["MIT"].split()
    edited = " ".join([*mit[:30], "altered", *mit[33:80], "odd", "words", *mit[80:]])
    assert licenses.scan_text(index, edited)[0][0] == "MIT" and licenses.scan_text(index, edited)[0][1] > 0.95
    assert licenses.scan_text(index, "nothing of the kind, under the sun") == []
    turkish = "İİİ Released under the MIT License."
    (_, _, _, a, b), = licenses.scan_text(index, turkish)
    assert turkish[a:b] == "Released under the MIT License"


def test_license_rows(spark, odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
    order = [n for n, _ in pipeline.STAGES]
    assert all(seen[n].columns == pipeline.COLUMNS for n in order[:-1])
    near = {re.sub(r"[\x20\x09-\x0D]+", " ", t): i for i, t in sorted(texts.items(), reverse=True)}
    assert {r["doc_id"] for r in seen["exact_dedup"].collect()} == set(near.values())
    assert seen["near_dedup"].count() <= seen["exact_dedup"].count()
    assert seen["packing"].agg(F.sum("length")).first()[0] == seen["packing"].where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pipeline.run(spark, SF).count() == seen["packing"].count()

def test_near_stage_is_brute_force(spark, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows, i = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e f")], 10
    for n in (5, 12, 40, 100, 300, 1000):
        for _ in range(6):
            base = [word() for _ in range(n)] + (passage if r.random() < 0.5 else [])
            for edits in (0, 0, 1, 1, 2, n // 60, n // 40, n // 25, n // 18, n // 10):
                copy = list(base)
                for at in r.sample(range(len(copy)), min(edits, len(copy))):
                    copy[at] = word()
                rows.append((i, " ".join(copy)))
                i += 1
    rows += [(10, rows[20][1] + " more"), (None, " ".join(passage)), (None, "quite other words")]
    r.shuffle(rows)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] == sets[y] or both * 10 >= 8 * (len(sets[x]) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    least: dict[int, tuple] = {}
    for x, (k, t) in enumerate(rows):
        own = (k is None, k or 0, hashlib.md5((t or "").encode()).hexdigest())
        least[root(x)] = min(own, least.get(root(x), own))
    got = pipeline.near_stage(spark, table(spark, [(k, t, "s") for k, t in rows]), SF).collect()
    assert sorted((d["doc_id"] is None, d["doc_id"] or 0, hashlib.md5((d["text"] or "").encode()).hexdigest()) for d in got) == sorted(least.values())
    assert pipeline.near_stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_near_pairs_by_blocks(spark, block):
    w = [f"w{k}" for k in range(60)]
    t = [(k, " ".join(w[:40] if k % 2 else w) + f" own{k % 7}", "") for k in range(40)]
    roots = {x["doc_id"]: x["root"] for x in near.near_classes(table(spark, t), block).collect()}
    assert len({roots[k] for k in range(0, 40, 2)}) == 1 == len({roots[k] for k in range(1, 40, 2)}) and roots[0] != roots[1]


def test_a_shared_passage_makes_no_candidates(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passages, rows, plain = [" ".join(word() for _ in range(45)) for _ in range(15)], {}, near.written

    def counted(df, name, *more):
        out = plain(df, name, *more)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near, "written", counted)
    t = [(k, " ".join(word() for _ in range(200)) + f" {passages[k // 2]} " + " ".join(word() for _ in range(250)), "") for k in range(30)]
    t += [(40 + k, t[k][1] + " more", "") for k in range(2)]
    roots = {x["doc_id"]: x["root"] for x in near.near_classes(table(spark, t)).collect()}
    assert len(set(roots.values())) == 30 and roots[40] == roots[0] and roots[41] == roots[1]
    # Only those that have a copy stay, though all share a passage's cells with another.
    assert rows["near-rows"] == 32 and rows["near-texts"] == 4


def test_stages_decide_by_row(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    texts_of = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    words = "an own text of many words that has letters".split()
    rows = [(None, " ".join(words)), (None, "?! 12"), (None, " ".join(reversed(words))), (5, " ".join(words[3:])), (5, " ".join(words[:6])), (5, " ".join(words[:6])), (6, "...")]
    docs = table(spark, [(i, t, "s") for i, t in rows])
    plain = lambda some: sorted((i is None, i or 0, t or "") for i, t in some)
    assert texts_of(stages["language"](spark, docs, SF)) == plain(x for x in rows if x[1] not in ("?! 12", "..."))
    assert texts_of(stages["exact_dedup"](spark, docs, SF)) == plain(set(rows))
    assert texts_of(stages["near_dedup"](spark, docs, SF)) == plain(set(rows))
    got = stages["mixing"](spark, docs, SF)
    total = sum(len(t.split()) for _, t in rows)
    assert got.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == int(total * 1.5)
    assert stages["exact_dedup"](spark, odd, SF).count() == 6 and stages["near_dedup"](spark, odd, SF).count() == 5
    assert stages["language"](spark, odd, SF).where("doc_id IS NULL").count() == 1
    assert {r["doc_id"] for r in stages["packing"](spark, stages["mixing"](spark, odd, SF), SF).collect()} <= {i for i, _, _ in ODD}
