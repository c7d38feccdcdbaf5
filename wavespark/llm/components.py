"""Connected components of a graph of longs, by rounds of hooking to the least neighbour.

Each round every vertex points to its least neighbour or itself, pointers are followed twice, and
the edges are drawn between what they point to. A vertex with many edges is met only by a minimum,
which has a map-side step, and by joins of two tables read from files, which Spark splits. Once
`SMALL` edges or fewer are left, one task ends the work on them in arrays: the bound of its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, free_shuffles, written

#: Edges that one task may hold, 16 bytes each.
SMALL = 500_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges a-b, and the least vertex that each reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return names, names[root]
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        found = least_reached(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["vertex", "root"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(vertex, root) for every vertex in edges (a, b): root is the least vertex it reaches. No edges: no rows.

    A null vertex has no edges. Each round drops the tables of the round before.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        return written(df, name, paths)

    def follow(pointers: DataFrame) -> DataFrame:
        onward = pointers.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        return put(pointers.join(onward, "root").select("vertex", F.col("next").alias("root")), "pointers")

    def after(roots: DataFrame | None, pointers: DataFrame) -> DataFrame:
        """Roots after pointers between them were found."""
        if roots is None:
            return pointers
        onward = pointers.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        return put(roots.join(onward, "root", "left").select("vertex", F.coalesce("next", "root").alias("root")), "roots")

    def keep(last: list[str]) -> None:
        for path in paths:
            if path not in last:
                drop_path(spark, path)
        paths[:] = last

    edges = put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while (left := edges.count()) > small:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root"))
        pointers = follow(follow(put(least.select("vertex", F.least("vertex", "root").alias("root")), "pointers")))
        last = paths[-1]
        half = edges.join(pointers.withColumnRenamed("vertex", "a"), "a").select(F.col("root").alias("x"), "b")
        half = put(half.where("x <> b").distinct(), "edges-half")
        full = half.join(pointers.withColumnRenamed("vertex", "b"), "b").where("x <> root")
        edges = put(full.select(F.least("x", "root").alias("a"), F.greatest("x", "root").alias("b")).distinct(), "edges")
        held = [paths[-1]]
        roots = after(roots, pointers)
        held.append(last if roots is pointers else paths[-1])
        free_shuffles(spark)
        keep(held)
    if left:
        roots = after(roots, put(edges.coalesce(1).mapInArrow(_in_one, "vertex BIGINT, root BIGINT"), "pointers"))
        keep(paths[-1:])
    return roots if roots is not None else edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
