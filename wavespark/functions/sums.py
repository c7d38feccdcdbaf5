"""Checksums over whole binaries of any length, with numpy.

A CRC is linear: a block's bytes each add what a table has for their place and value, and the state
before the block goes on through a table of its own. A short block comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import CRCS

#: Bytes of a block.
BLOCK = 256

#: Blocks that are looked up at once.
_AT_ONCE = 4096

NAMES = [*CRCS, "lin", "xored"]


def _advance(states: np.ndarray, width: int, poly: int, reflect: bool, shifts: int) -> np.ndarray:
    for _ in range(shifts):
        if reflect:
            states = states >> 1 ^ np.where(states & 1, poly, 0)
        else:
            states = (states << 1 & (1 << width) - 1) ^ np.where(states >> width - 1 & 1, poly, 0)
    return states


@cache
def _tables(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte at a place of a block adds, a state after a block, and the start after 0 to BLOCK bytes."""
    width, poly, init, _, reflect = CRCS[name]
    low = name == "can_crc15"  # a bit for each byte: its lowest
    shifts = 1 if low else 8
    byte = np.arange(256, dtype=np.int64)
    if low:
        adds = np.where(byte & 1, poly, 0)
    elif reflect:
        adds = _advance(byte, width, poly, True, 8)
    else:
        adds = np.zeros(256, dtype=np.int64)
        for k in range(7, -1, -1):
            top = adds >> width - 1 & 1 ^ byte >> k & 1
            adds = (adds << 1 & (1 << width) - 1) ^ np.where(top, poly, 0)
    places = np.zeros((BLOCK, 256), dtype=np.uint16)
    starts = np.zeros(BLOCK + 1, dtype=np.int64)
    start = np.array([init], dtype=np.int64)
    for k in range(BLOCK):
        places[BLOCK - 1 - k], starts[k] = adds, start[0]
        adds, start = _advance(adds, width, poly, reflect, shifts), _advance(start, width, poly, reflect, shifts)
    starts[BLOCK] = start[0]
    after = _advance(np.arange(1 << width, dtype=np.int64), width, poly, reflect, shifts * BLOCK)
    return places, after, starts


def crc(name: str, data: np.ndarray) -> int:
    """The named CRC of an array of bytes."""
    places, after, starts = _tables(name)
    first = len(data) % BLOCK
    state = int(starts[first])
    if first:
        state ^= int(np.bitwise_xor.reduce(places[np.arange(BLOCK - first, BLOCK), data[:first]]))
    blocks = data[first:].reshape(-1, BLOCK)
    for at in range(0, len(blocks), _AT_ONCE):
        for add in np.bitwise_xor.reduce(places[np.arange(BLOCK), blocks[at : at + _AT_ONCE]], axis=1).tolist():
            state = int(after[state]) ^ add
    return state ^ CRCS[name][3]


def lin(data: np.ndarray) -> int:
    """Carry-add of all bytes, inverted."""
    total = int(data.sum(dtype=np.int64))
    return 255 - (total and (total - 1) % 255 + 1)


def checksums(docs: DataFrame, names: list[str] = NAMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the named sums) over the UTF-8 bytes of each whole text; a null text is empty."""

    def one(name: str, data: np.ndarray) -> int:
        return lin(data) if name == "lin" else int(np.bitwise_xor.reduce(data)) if name == "xored" else crc(name, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(t.as_buffer() or b"", dtype=np.uint8) for t in batch.column(1)]
            sums = [pa.array([one(n, t) for t in texts], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], ["doc_id", *names])

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id BIGINT", *(f"{n} BIGINT" for n in names)]))
