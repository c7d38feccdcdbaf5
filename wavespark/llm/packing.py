"""Cost-balanced packing of token ids into sequences.

Documents are packed in groups as they are read, without a shuffle. Full lengths of a long document
are sequences of their own. The remainders go, longest first, to the sequence of lowest cost that
has room: the cost of a piece is linear plus quadratic in its length, as attention's is. A remainder
that fits nowhere is cut over the sequences with most room. The capacities of a group add up to its
ids: whole sequences, then one for each power of two of what is left, so that nothing is padded.

Defined results: a null text is empty, an empty text is its end id; ties go by place in the
input; repeated rows are packed each; a null doc_id stays null; an empty table gives no pieces. A
sequence's number is the input partition's, shifted by 32 bits, plus a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of
from .encode import encoder, tokenizer_path

SCHEMA = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"

#: Ids packed together: bounds a task's memory.
GROUP_IDS = 4_000_000


def pack_lengths(lengths: list[int], capacity: int = 4096, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of these lengths: (document, start, length, sequence, offset) pieces.

    Sequences are numbered from 0 and hold capacity ids, or a smaller power of two.
    """
    pieces, rest, sequence = [], [], 0
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((i, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, i))
    total = sum(n for n, _ in rest)
    tail = total % capacity
    caps = [capacity] * (total // capacity) + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]
    if capacity & (capacity - 1):  # then no power of two is a full one: one padded sequence takes what is left
        caps = [capacity] * -(-total // capacity)
    room, cost = np.array(caps, dtype=np.int64), np.zeros(len(caps))
    full = np.array(caps, dtype=np.int64)

    def put(i: int, start: int, n: int, s: int) -> None:
        pieces.append((i, start, n, sequence + s, int(full[s] - room[s])))
        room[s] -= n
        cost[s] += n + quadratic * n * n

    for n, i in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = lengths[i] - n
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            part = min(n, int(room[s]))
            put(i, start, part, s)
            start, n = start + part, n - part
    return pieces


def _packed(path: str, end_id: int, capacity: int, quadratic: float):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, spaced=False), np.array([end_id], dtype="<u4").tobytes()
        base, keys, ids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, keys, ids, size
            found = pack_lengths([len(x) // 4 for x in ids], capacity, quadratic)
            rows = [
                (keys[i], start, n, zlib.crc32(ids[i][4 * start : 4 * (start + n)]), len(ids[i]) // 4, base + s, at)
                for i, start, n, s, at in found
            ]
            base += max(s for *_, s, _ in found) + 1
            keys, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                new = [x + end for x in enc.encode(some.column(1).to_pylist())]
                keys += some.column(0).to_pylist()
                ids += new
                size += sum(map(len, new)) // 4
                if size > GROUP_IDS:
                    yield flush()
        if ids:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 2,
    capacity: int = 4096,
    quadratic: float = 1 / 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents: SCHEMA. capacity should be a power of two."""
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_packed(tokenizer, end_id, capacity, quadratic), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
