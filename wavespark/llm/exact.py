"""Exact deduplication with a persistent digest index (native: DataFrame functions only).

The index is a Parquet table of (digest, keep_id), bucketed and sorted by digest, in the shared
folder. New rows are reduced to one row a digest, matched with the index by a sort-merge
anti-join, and what is new is appended. Texts are equal if identical once each run of ASCII white
space is one space; the SHA-256 of that text, in UTF-8, is the digest.

Hot groups: rows are counted by (digest, part) and then by digest, so that a map-side sum stands
before each exchange, and answers go back by (digest, part). No task holds a group of copies.

Defined results: a null text is empty; empty texts are one group; a null doc_id sorts before all
others; a doc_id that repeats with one text keeps one of its rows; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_SPACE, new_path, salt, salts, text_of, written

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT"


def text_digest(text_col: str = "text") -> Column:
    """The SHA-256 of a text with each run of ASCII white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), WHITE_SPACE, " "), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"))


class DigestIndex:
    """Which digests the corpus has, and the document that stands for each."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        """Opens the index at path, or begins an empty one. buckets holds for the index's whole life."""
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "digest-index"), buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forgets the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame) -> None:
        """Adds those (digest, keep_id) rows, one a digest, that the index doesn't have.

        Done again after a failure it adds nothing twice: what is there is not new.
        """
        known = self.table().select("digest")
        new = groups.select("digest", "keep_id").join(known.hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest")  # one file a bucket
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(
            self.name, path=self.path
        )
        self.spark.catalog.refreshTable(self.name)

    def assign(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicates docs against the index and among themselves, and appends what is new.

        Per row of docs: doc_id, keep_id, group_size (rows of docs with that text), kept (this row
        stays: it stands for its text), digest.
        """
        n = salts(self.spark)
        rows = written(digests(docs, id_col, text_col), "digests")
        rows = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.withColumn("part", salt(["doc_id"], n))
        parts = rows.groupBy("digest", "part").agg(
            F.min("doc_id").alias("first"), F.sum("copies").alias("size"), F.max(F.col("doc_id").isNull()).alias("none")
        )
        groups = parts.groupBy("digest").agg(
            F.when(~F.max("none"), F.min("first")).alias("keep_id"), F.sum("size").alias("group_size")
        )
        self.append(groups)
        found = groups.select("digest", "group_size").join(self.table(), "digest")
        answers = parts.select("digest", "part").join(found, "digest")
        out = rows.join(answers, ["digest", "part"])
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document against the index at path (a new one if None): see DigestIndex.assign."""
    index = DigestIndex(docs.sparkSession, path)
    return index.assign(docs, id_col, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
