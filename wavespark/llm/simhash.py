"""SimHash fingerprints of whole texts and their near-duplicate classes.

Fingerprints: words are what ASCII white space parts, A-Z lower-cased; each shingle of words, joined
by spaces, is hashed by XXH64; a bit is set if over half the hashes have it.

Links: fingerprints at most `distance` bits apart. Equal fingerprints are one point. A point is
embedded by the bit counts of its 32 segments of two bits; the Manhattan distance of two such
vectors is at most the Hamming distance of their points. The vector's segments are dealt to bands,
twice as many as the distance: two points in reach have equal counts in at least half of the bands,
so each choice of half the bands is a grid and its counts are a cell. Points that share a cell are
compared by Manhattan distance first and then by their bits. No link is lost and nothing is sampled.

A cell gives a spanning forest of its links, not all pairs. A cell with more points than BLOCK is
dealt to blocks, and each pair of blocks is a task's work of bounded size.

Defined results: a null or wordless text has fingerprint 0, which links like any other; fewer words
than a shingle are one shingle; repeated rows are in one class; a null doc_id takes part and stands
for a class only if no other does; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_shuffles, signed, text_of, written
from .components import components

#: Points of a cell that are compared in one task, about.
BLOCK = 4096

#: Stands for a null doc_id as a vertex.
NO_ID = (1 << 63) - 1

_EVEN = np.uint64(0x5555555555555555)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have; 0 of none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 50_000):
        some = hashes[at : at + 50_000].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, seed)
    ends = [x - 1 for x in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(x + 1 for x in ends[:-words])]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(text_fingerprint(t.as_py(), words, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, fp BIGINT")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, packed in a long."""
    even, upper = F.lit(signed(int(_EVEN))), F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(upper).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(even), 1))


def cell_masks(distance: int = 3) -> list[int]:
    """The segments of each grid: all choices of half the bands."""
    bands = 2 * distance or 1
    band = [sum(3 << 2 * s for s in range(32) if s * bands // 32 == b) for b in range(bands)]
    return [sum(band[b] for b in some) for some in combinations(range(bands), max(1, bands - distance))]


def _counts(fps: np.ndarray) -> np.ndarray:
    return fps - (fps >> np.uint64(1) & _EVEN)


def _near(fp: np.uint64, count: np.uint64, fps: np.ndarray, counts: np.ndarray, distance: int) -> np.ndarray:
    """Which fps are in reach of fp: the Manhattan bound on the counts, then the bits."""
    x = counts ^ count
    low, high = x & _EVEN, x >> np.uint64(1) & _EVEN
    bound = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)
    near = bound <= distance
    near[near] = np.bitwise_count(fps[near] ^ fp) <= distance
    return near


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that link the points as their links within the distance do."""
    counts, left, links = _counts(fps), np.arange(len(fps)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = _near(fps[i], counts[i], fps[left], counts[left], distance)
            new = left[near]
            left = left[~near]
            links += [(int(i), int(j)) for j in new]
            reached += new.tolist()
    return links


def _linked(distance: int):
    """Links in each run of rows of one (cell, i, j); runs may go over batches."""

    def of(cells: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(cells)]
        links = []
        pair = ends - starts == 2
        first = starts[pair]
        near = np.bitwise_count(fps[first] ^ fps[first + 1]) <= distance
        links += zip(first[near].tolist(), (first[near] + 1).tolist(), strict=True)
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            links += [(a + i, a + j) for i, j in forest(fps[a:b], distance)]
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, i, j, fps, ids = (c.to_numpy() for c in batch.columns)
            rows = (np.stack([cell, i.astype(np.int64), j.astype(np.int64)], axis=1), fps.astype(np.int64).view(np.uint64), ids)
            if held and (held[-1][0][-1] != rows[0][-1]).any():
                # The last run of this batch may go on; all before it is whole.
                last = int(np.flatnonzero((rows[0] != rows[0][-1]).any(axis=1))[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
                held.append(tuple(x[:last] for x in rows))
                yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [tuple(x[last:] for x in rows)]
            else:
                held.append(rows)
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(points: DataFrame, distance: int = 3, block: int = BLOCK, paths: list[str] | None = None) -> DataFrame:
    """(a, b): ids of points (fp, id; one row a fingerprint) such that components of these links are those of all links."""
    counts = segment_counts(F.col("fp"))
    masks = cell_masks(distance)
    grid = F.explode(F.array(*(F.xxhash64(F.lit(n), counts.bitwiseAND(F.lit(signed(m)))) for n, m in enumerate(masks))))
    cells = written(points.select(grid.alias("cell"), "fp", "id"), "cells", paths)
    sizes = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cell-sizes", paths)
    shared = cells.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = shared.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "id")
    work = work.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return work.mapInArrow(_linked(distance), "a BIGINT, b BIGINT")


def near_classes(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    spark = docs.sparkSession
    rows = written(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash")
    points = rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"))
    points = written(points, "simhash-points")
    free_shuffles(spark)
    roots = components(links(points, distance)).withColumnRenamed("vertex", "id")
    named = points.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("root"))
    named = written(named, "simhash-classes")
    component = F.when(F.col("root") != NO_ID, F.col("root"))
    return rows.join(named, "fp").select("doc_id", "fp", component.alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_classes(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
