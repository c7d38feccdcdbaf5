"""SimHash near-duplicates that hold exactly: every link is a Jaccard similarity of PERCENT or more.

Words are what ASCII white space parts, A-Z lower-cased; a shingle is five words in a row, known by
64 bits of hash; fewer words are one shingle. Two texts are linked if their sets of shingles have a
Jaccard similarity of PERCENT or more, and classes are the components of all links.

Three sources of candidates, each of whose pairs is verified on the whole sets:

1. SimHash: equal fingerprints of the sets, and those that the segment grids of `simhash.links` join.
2. Cells' stars: see below. They are verified together with the first.
3. All pairs of a cell whose classes still differ.

SimHash alone loses links: at a similarity of 0.8 two 64-bit fingerprints differ by ten bits on
average, beyond what grids over segments can reach. So what it leaves is found by shingles. All
shingles have one order, those often met in a sample last and else by hash. Sets of n and m shingles
that are similar enough share at least ceil(0.8 max(n, m)), so the first n - ceil(0.8 n) + k
shingles of both have k in common: shares_of(min(n, m)) at least. The order changes how many
candidates there are, never a link: none is lost and nothing is capped. Each shingle among the first
ones is a cell. A set of n is similar only to sets of at least 0.8 n, so one with fewer cells that
others have than shares_of(0.8 n) is similar to none, and leaves: most that share no more than a
passage do. All members of a cell are compared with its least id first, and the links found are
made classes; then all pairs of a cell whose classes differ. Cells of one least id go to one task as
a group, a row a member with its cells, or by pairs of blocks of members. A large group of copies so
costs a comparison a member, not one a pair; and a pair leaves a task once a group, not once a cell, and only
if sketches of both sets, whose distance is a lower bound of what the sets have apart, and the cells
that both have elsewhere leave a link possible.

Defined results: equal sets are one point, known by 64 bits of hash; a null text is empty, and
wordless texts are one class; a row is known by the MD5 of its text, so a null or repeated doc_id
stands for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import drop_path, free_shuffles, salt, salts, signed, text_of, written
from .components import components

WORDS = 5

#: The least similarity, in hundredths.
PERCENT = 80

#: Points of a group that are compared in one task, about.
BLOCK = 1024

#: Runs of at most FEW points are compared TOGETHER rows at a time.
FEW, TOGETHER = 64, 8192

#: Cells that are looked up at once.
LOOKED_UP = 1 << 20

#: 64-bit words of a set's sketch: LONG from SIZE shingles on.
SHORT, LONG, SIZE = 8, 32, 900

#: About so many documents tell which shingles are frequent, and so many shingles at most are.
SAMPLE, FREQUENT = 10_000, 200_000


#: Bytes of a text whose words are hashed at once; a piece ends between words.
PIECE = 1 << 20

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_GAP = re.compile(rb"[\x20\x09-\x0D]")

#: Of the powers that a word's hash is a polynomial in; odd, so that it has an inverse.
_BASE = 0x9E3779B97F4A7C15

_powers: dict[str, np.ndarray] = {}


def _table(name: str, size: int) -> np.ndarray:
    """The values of the bytes, or at least size powers of the base or of its inverse, modulo 2**64."""
    have = _powers.get(name)
    if name == "bytes":
        if have is None:
            from xxhash import xxh64_intdigest

            have = _powers[name] = np.array([xxh64_intdigest(bytes([b]), 5) for b in range(256)], dtype=np.uint64)
    elif have is None or len(have) < size:
        step = _BASE if name == "base" else pow(_BASE, -1, 1 << 64)
        factors = np.full(1 << max(12, size.bit_length()), step, dtype=np.uint64)
        factors[0] = 1
        have = _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return have


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits of each word, in order: sums of the bytes' values times powers, taken from a running sum."""
    found = []
    for piece in _pieces(text):
        raw = np.frombuffer(piece.lower(), np.uint8)
        bounds = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
        starts, ends = bounds[::2], bounds[1::2]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_table("bytes", 256)[raw] * _table("base", len(raw))[: len(raw)], out=sums[1:])
        found.append((sums[ends] - sums[starts]) * _table("inverse", len(raw))[starts])
    return np.concatenate(found)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        x = w[k : len(w) - size + 1 + k]
        h = (h ^ x ^ x >> np.uint64(31)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.sort(h ^ h >> np.uint64(32))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have that Jaccard similarity or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """A bit for each of 512 or 2048 segments of the hashes: whether an odd number of the set's shingles fall in it.

    Each shingle that one of two sets lacks turns one bit, so the bits that differ are at most those shingles.
    """
    words = SHORT if len(own) < SIZE else LONG
    odd = np.bincount((own & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _least_apart(one: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A lower bound of how many shingles one set and each of some have apart, by sketches; the longer is folded."""
    words = min(len(one), some.shape[1])
    one = np.bitwise_xor.reduce(one.reshape(-1, words), axis=0)
    return np.bitwise_count(some[:, :words] ^ one).sum(axis=1, dtype=np.int64)


def shares_of(n):
    """How many of their first shingles similar sets share, the smaller of which has n; a number or a column."""
    return 1 + n // 20 if isinstance(n, int) else F.floor(n / 20) + 1


def firsts(own: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The first shingles of a set, and how many of them are not frequent; these come before the others.

    frequent is sorted, ranks are its places from 1, by how often it is met.
    """
    n = len(own)
    size = min(n, n - -(-n * percent // 100) + shares_of(n))
    rare = n
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        places = np.where(frequent[at] == own, ranks[at], 0)
        own, rare = own[np.argsort(places, kind="stable")], n - np.count_nonzero(places)
    return own[:size], min(size, int(rare))


def text_key(column: str = "text") -> Column:
    """What a row is known by: its text's MD5."""
    return F.md5(text_of(column).cast("binary"))


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three documents or more of a sample have, and their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["h"])

    n = docs.count()
    part = F.pmod(F.xxhash64(F.lit("near"), text_key(text_col)), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30)
    some = docs.where(part).select(text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "h BIGINT")
    met = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT)
    rows = met.toPandas()
    h, often = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(h)
    ranks = np.empty(len(h), dtype=np.int64)
    ranks[np.lexsort((h, often))] = np.arange(1, len(h) + 1)
    return h[order], ranks[order]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, id, fp, n, sketch, firsts, rare) of each row.

    id is its set's hash, fp its SimHash, n the set's size and rare the number of firsts before the frequent ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            ids, fps, sizes, sketches, first, rare = [], [], [], [], [], []
            for t in batch.column(2):
                own = shingles(t.as_py())
                ids.append(xxh3_64_intdigest(own.tobytes()))
                fps.append(signed(simhash.majority(own)))
                sizes.append(len(own))
                sketches.append(sketch(own).tobytes())
                some, before = firsts(own, *shared.value)
                first.append(some.view(np.int64))
                rare.append(before)
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else [], pa.int64()))
            ids = pa.array(np.array(ids, dtype=np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), ids, pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists, pa.array(rare, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "id", "fp", "n", "sketch", "firsts", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, key STRING, id BIGINT, fp BIGINT, n BIGINT, sketch BINARY, firsts ARRAY<BIGINT>, rare INT")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, n) of the cells that two rows or more have, among rows (cell, part, id, n) in order.

    Parts from 0 on are those of frequent cells, whose rows all stay. A row waits for the next one only.
    """
    held: list[np.ndarray] | None = None
    mate = False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
        cell, part, ids, n = columns
        same = (cell[1:] == cell[:-1]) & (part[1:] == part[:-1])
        stays = part >= 0
        stays[1:] |= same
        stays[:-1] |= same
        stays[0] |= mate
        held, mate = [c[-1:] for c in columns], bool(stays[-1])
        at = np.flatnonzero(stays[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (cell, ids, n)], ["cell", "id", "n"])
    if held is not None and mate:
        yield pa.RecordBatch.from_arrays([pa.array(held[k]) for k in (0, 2, 3)], ["cell", "id", "n"])


def _shared_cells(points: DataFrame) -> DataFrame:
    """(cell, id, n): the cells that two points or more have. They move once; frequent ones are dealt in parts."""
    cells = points.select(F.posexplode("firsts").alias("at", "cell"), "rare", "id", "n")
    part = F.when(F.col("at") >= F.col("rare"), salt(["id"], salts(points.sparkSession))).otherwise(-1)
    cells = cells.select("cell", part.alias("part"), "id", "n")
    return cells.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_met, "cell BIGINT, id BIGINT, n BIGINT")


def _linkable(cells: DataFrame) -> DataFrame:
    """Rows (id, n, ...), a row a cell, of the ids with as many cells as they share with any similar set; met: how many."""
    met = cells.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return met.where(F.col("met") >= shares_of(F.expr(f"(n * {PERCENT} + 99) div 100")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The key (cell, i, j) and the other columns of each run of rows; runs may go over batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys = np.stack([c.astype(np.int64) for c in cols[:3]], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[a].tolist())
            if held and now != last:
                yield last, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append([c[a:b] for c in cols[3:]])
            last = now
    if held:
        yield last, [np.concatenate(c) for c in zip(*held, strict=True)]


def _may_link(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be similar, if bound is the least that they have apart.

    At a similarity of PERCENT they have at most (n + m) (100 - PERCENT) / (100 + PERCENT) apart.
    """
    return bound * (100 + PERCENT) <= (n + m) * (100 - PERCENT)


def _sketches(n: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every sketch in SHORT words, the long ones as they are, and the place of each row's long one."""
    is_long = n >= SIZE
    brief = np.zeros((len(n), SHORT), dtype=np.uint64)
    long = np.frombuffer(b"".join(sketches[is_long].tolist()), "<u8").reshape(-1, LONG)
    brief[~is_long] = np.frombuffer(b"".join(sketches[~is_long].tolist()), "<u8").reshape(-1, SHORT)
    brief[is_long] = np.bitwise_xor.reduce(long.reshape(-1, LONG // SHORT, SHORT), axis=1)
    return brief, long, np.cumsum(is_long) - 1


def _large_run(across: bool, n: np.ndarray, block: np.ndarray, roots: np.ndarray, sketches: np.ndarray):
    """The pairs of one run as places, a row against the others at a time; across: blocks must differ."""
    order = np.argsort(n, kind="stable")
    n, block, roots, sketches = n[order], block[order], roots[order], sketches[order]
    ends = np.searchsorted(n * PERCENT, n * 100, side="right")
    # Sorted by size, so the short sketches are first; each row is compared in the words that it has itself.
    brief, long, _ = _sketches(n, sketches)
    short = len(n) - len(long)
    for x in range(len(n)):
        some = slice(x + 1, ends[x])
        apart = roots[some] != roots[x]
        if across:
            apart &= block[some] != block[x]
        at = np.flatnonzero(apart) + x + 1
        bound = _least_apart(brief[x], brief[at]) if x < short else _least_apart(long[x - short], long[at - short])
        at = at[_may_link(bound, n[at], n[x])]
        if len(at):
            yield np.full(len(at), order[x]), order[at]


def _small_runs(run: np.ndarray, across: np.ndarray, n: np.ndarray, block: np.ndarray, roots: np.ndarray, sketches: np.ndarray):
    """The pairs of many runs as places, all rows against those so many rows on at a time; across: blocks must differ."""
    order = np.lexsort((n, run))
    run, across, n, block, roots, sketches = (c[order] for c in (run, across, n, block, roots, sketches))
    brief, long, place = _sketches(n, sketches)
    for step in range(1, len(run)):
        x = np.flatnonzero(run[step:] == run[:-step])
        if not len(x):
            break
        y = x + step
        may = (n[y] * PERCENT <= n[x] * 100) & (roots[x] != roots[y]) & (~across[x] | (block[x] != block[y]))
        x, y = x[may], y[may]
        may = _may_link(np.bitwise_count(brief[x] ^ brief[y]).sum(axis=1, dtype=np.int64), n[x], n[y])
        x, y = x[may], y[may]
        both = np.flatnonzero(n[x] >= SIZE)
        bound = np.bitwise_count(long[place[x[both]]] ^ long[place[y[both]]]).sum(axis=1, dtype=np.int64)
        may = np.ones(len(x), dtype=bool)
        may[both] = _may_link(bound, n[x[both]], n[y[both]])
        if may.any():
            yield order[x[may]], order[y[may]]


def _in_common(x: np.ndarray, y: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many cells rows x and y have in common, pair by pair; cells: an array for each row."""
    sizes = np.array([len(c) for c in cells], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    names, at = np.unique(np.concatenate(cells), return_inverse=True)
    own = np.sort(np.repeat(np.arange(len(cells)), sizes) * len(names) + at)
    x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
    ends, found, a = np.cumsum(sizes[x]), np.zeros(len(x), dtype=np.int64), 0
    while a < len(x):
        before = ends[a] - sizes[x[a]]
        b = max(a + 1, int(np.searchsorted(ends, before + LOOKED_UP, side="right")))
        pair = np.repeat(np.arange(a, b), sizes[x[a:b]])
        place = starts[x[pair]] + np.arange(len(pair)) - (ends[pair] - sizes[x[pair]] - before)
        want = y[pair] * len(names) + at[place]
        met = own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want
        found[a:b] = np.bincount(pair[met] - a, minlength=b - a)
        a = b
    return found


def _cell_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, cells): pairs of a run whose classes differ and whose sizes and sketches allow a link.

    n is the lesser size, cells how many cells the pair has in common: 1, if a run is a cell. If rows end in their
    cells and met, how many they have in all runs, a pair without one goes, and one that can't have enough in all.
    Small runs are taken TOGETHER rows at a time, larger ones alone.
    """

    def of(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: np.ndarray, ids: np.ndarray, cells: np.ndarray | None = None, met: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        if met is not None:
            others = met - np.array([len(c) for c in cells], dtype=np.int64)
        for x, y in _together(pairs):
            least, both = np.minimum(n[x], n[y]), np.ones(len(x), dtype=np.int64)
            if met is not None:
                both = _in_common(x, y, cells)
                may = (both > 0) & (both + np.minimum(others[x], others[y]) >= 1 + least // 20)
                x, y, least, both = x[may], y[may], least[may], both[may]
            yield np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), least, both

    def pairs() -> Iterator[tuple[np.ndarray, ...]]:
        small: list[list[np.ndarray]] = []
        rows = 0

        def of_small() -> Iterator[tuple[np.ndarray, ...]]:
            run, across, n, block, ids, roots, sketches, *more = (np.concatenate(c) for c in zip(*small, strict=True))
            yield from of(_small_runs(run, across, n, block, roots, sketches), n, ids, *more)

        for (_, i, j), columns in _runs(batches):
            size = len(columns[0])
            if size > FEW:
                n, block, ids, roots, sketches, *more = columns
                yield from of(_large_run(i != j, n, block, roots, sketches), n, ids, *more)
                continue
            small.append([np.full(size, len(small)), np.full(size, i != j), *columns])
            rows += size
            if rows > TOGETHER:
                yield from of_small()
                small, rows = [], 0
        if small:
            yield from of_small()

    for found in _together(pairs()):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "n", "cells"])


def _together(found: Iterator[tuple[np.ndarray, ...]], most: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows, about so many at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for some in found:
        held.append(some)
        size += len(some[0])
        if size > most:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (a, part, b, text), in order; the row without b has a's own text."""
    whose, own = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        links = []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if b is None:
                whose, own = a, shingles(text.as_py())
            elif whose == a and similar(own, shingles(text.as_py())):
                links.append((a, b))
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, paths: list[str]) -> DataFrame:
    """Those pairs (a, b) whose texts (id, text) are similar; a's text goes to each part of its pairs."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")), "near-pairs", paths)
    owns = pairs.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("id")).distinct()
    both = owns.unionAll(pairs.select("a", "part", "b", F.col("b").alias("id"))).join(texts, "id")
    work = both.select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(work.mapInArrow(_verified, "a BIGINT, b BIGINT"), "near-links", paths)


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, n, cells) with as many cells in common, in all their rows, as similar sets have."""
    met = pairs.groupBy("a", "b").agg(F.sum("cells").alias("cells"), F.first("n").alias("n"))
    return met.where(F.col("cells") >= shares_of(F.col("n")))


def _by_simhash(points: DataFrame, distance: int, paths: list[str]) -> DataFrame:
    """Pairs (a, b) of points whose fingerprints are equal or linked by the grids; a chain, not all pairs."""
    prints = written(points.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")), "near-prints", paths)
    equal = points.join(prints.where("size > 1"), "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return equal.unionAll(simhash.links(prints.select("fp", F.col("least").alias("id")), distance, paths=paths))


def near_classes(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(doc_id, key, root) of each row; rows of a class have one root."""
    spark = docs.sparkSession
    paths: list[str] = []
    signed_rows = written(signatures(docs, id_col, text_col), "near-signatures", paths)
    firsts = [F.first(c).alias(c) for c in ("fp", "n", "sketch", "firsts", "rare")]
    points = written(signed_rows.groupBy("id").agg(*firsts, F.min("key").alias("key")), "near-points", paths)
    rows = written(signed_rows.select("doc_id", "key", "id"), "near-rows")
    drop_path(spark, paths.pop(0))
    free_shuffles(spark)
    shared = written(_linkable(_shared_cells(points)).drop("met"), "near-cells", paths)
    free_shuffles(spark)
    keys = points.select("id", "key").join(shared.select("id").distinct(), "id")
    # Copies meet on the map side, and the join deals by the same key, so texts move once.
    texts = docs.select(text_key(text_col).alias("key"), text_of(text_col).cast("binary").alias("text"))
    texts = written(texts.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key").select("id", "text"), "near-texts", paths)
    free_shuffles(spark)

    # What has too few cells in common with others is similar to nothing and has no text here.
    least = shared.groupBy("cell").agg(F.min(F.struct("id", "n")).alias("least"))
    stars = shared.join(least, "cell").where(f"id <> least.id AND greatest(n, least.n) * {PERCENT} <= least(n, least.n) * 100")
    stars = stars.select(F.col("least.id").alias("a"), F.col("id").alias("b"), F.least("n", "least.n").alias("n"), F.lit(1).alias("cells"))
    links = _links(_by_simhash(points, distance, paths).unionAll(_enough(stars).select("a", "b")), texts, paths)
    free_shuffles(spark)

    roots = components(links).withColumnRenamed("vertex", "id")
    members = written(shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "near-named", paths)
    mixed = members.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("least"))
    apart = _linkable(members.join(mixed.where("low <> high").select("cell", "least"), "cell"))
    groups = apart.groupBy("id", "least").agg(*(F.first(c).alias(c) for c in ("n", "root", "met")), F.collect_list("cell").alias("cells"))
    groups = written(groups.join(points.select("id", "sketch"), "id"), "near-groups", paths)
    sizes = groups.groupBy("least").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    blocks = groups.join(sizes.where("low <> high").select("least", "size"), "least").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    work = blocks.select("least", i, j, "n", "block", "id", "root", "sketch", "cells", "met")
    work = work.repartition("least", "i", "j").sortWithinPartitions("least", "i", "j")
    rest = _links(_enough(work.mapInArrow(_cell_pairs, "a BIGINT, b BIGINT, n BIGINT, cells BIGINT")).select("a", "b"), texts, paths)
    free_shuffles(spark)

    roots = components(links.unionAll(rest)).withColumnRenamed("vertex", "id")
    for path in paths:
        drop_path(spark, path)
    return rows.select("doc_id", "key", "id").join(roots, "id", "left").select("doc_id", "key", F.coalesce("root", "id").alias("root"))


def kept(classes: DataFrame) -> DataFrame:
    """(doc_id, key): the row of least doc_id of each class, one without doc_id only if there is no other."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    return classes.groupBy("root").agg(least.alias("least")).select("least.doc_id", "least.key")
