"""Token ids as Parquet list columns, and selective reads of them.

A dataset is a folder of Parquet files in ascending doc_id order: doc_id, n_tokens and the list
tokens. Ids are dictionary-encoded (a vocabulary of 50,000 is two bytes an id), doc_id and n_tokens
delta-encoded; row groups and pages are small and have column and offset indexes, so that a read of
some documents or of the counts alone skips the rest.

Defined results: a null text is empty, an empty text is its end id; a null doc_id comes first;
repeated rows each keep their ids, those of one doc_id ordered by text; an empty table gives an
empty dataset. Texts move once, by ranges of doc_id, and ids never.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cuts, documents, new_path, range_of, text_of
from .encode import encoder, tokenizer_path

SCHEMA = "doc_id BIGINT, n_tokens INT, tokens ARRAY<INT>"

#: What the Parquet writer is told. Version 2 pages delta-encode integers that have no dictionary.
LAYOUT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, spaced=True), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [x + end for x in enc.encode(some.column(1).to_pylist())]
                sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int32, count=len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), lists], ["doc_id", "n_tokens", "tokens"])

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encodes docs and writes the dataset to path, a folder that all executors reach."""
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    bounds = cuts(rows, "doc_id", max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartitionById(len(bounds) + 1, range_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encoded(tokenizer, end_id), SCHEMA).write.options(**LAYOUT).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The dataset's columns, with the place of each row: part (number of the file) and row_index."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    names = columns or ["doc_id", "n_tokens", "tokens"]
    return spark.read.schema(SCHEMA).parquet(path).select(*names, part.alias("part"), F.col("_metadata.row_index").alias("row_index"))


def starts(rows: DataFrame) -> DataFrame:
    """Adds start, the number of ids of all rows before, to rows with part, row_index and n_tokens.

    Files are summed first; the sums, one a file, are added up in order; then each file by itself.
    """
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    files = files.select("part", F.coalesce(F.sum("ids").over(every), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        offsets = lists.offsets.to_numpy()
        ids = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        sizes = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("row_index"), batch.column("doc_id"), sizes, pa.array(sums, pa.int64())],
            ["part", "row_index", "doc_id", "n_tokens", "ids_crc32"],
        )


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(documents(spark, sf_dir), new_path(spark, "tokens"))
    rows = read_tokens(spark, path, ["doc_id", "tokens"])
    sums = rows.mapInArrow(_checksums, "part BIGINT, row_index BIGINT, doc_id BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
    place = starts(read_tokens(spark, path, ["n_tokens"])).select("part", "row_index", "start")
    return sums.join(place, ["part", "row_index"]).select("doc_id", "start", "n_tokens", "ids_crc32")
