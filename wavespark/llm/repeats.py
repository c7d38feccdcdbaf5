"""Repeated byte strings across documents by an enhanced suffix array, and their removal.

A repeat is a string of `least` bytes or more that stands in two documents or more. A suffix array
of a whole corpus doesn't fit a task, so suffixes are dealt by the start of their text: each
window of `least` bytes has an anchor, the least hash among its GRAM-byte grams, and suffixes with
one anchor hash are sorted together. Equal windows have equal anchors, so no repeat is parted.

1. Equal texts are one text, named by its least doc_id. Texts are written once, bucketed by it.
2. Anchors that only one text has are dropped. Runs meet by anchor to tell; those of anchors that a
   sample shows in very many texts are repeated anyway and are spread by text.
3. Runs of windows with one anchor are at most 84 bytes each. Equal runs, by anchor and a 64-bit hash
   of their bytes, are one content with its least and greatest doc_id; the occurrences stay in a
   table. A content that has its anchor alone is a maximal repeat as it is.
4. Of the others the bytes are cut out, once a content, and those of one anchor sorted by suffix. A stack scan over common-prefix lengths gives the
   interval tree. An interval is a maximal repeat if what stands left of its members differs or the
   run begins there: these are the groups, with every member, not just neighbours. A group of
   occurrences is its members' contents and their occurrences; repeats longer than a run are groups
   of consecutive runs, which overlap.
5. Occurrences look up their content's groups; a group with a smaller doc_id covers its bytes.

Hot strings: copies are one text, equal runs one content, and both are reduced before they move. An
anchor with more contents than CROWD, as around a passage of very many documents, isn't sorted in
one task: its windows become contents of their own, which are equal or have nothing in common.
Occurrences meet anchors and contents in joins of two tables read from files, which Spark splits.

Defined results: a null text is empty; texts shorter than `least` keep everything; of rows with
equal texts the least doc_id keeps what is new, and rows with that doc_id all do; a null doc_id is
greater than all others; doc_id is taken to be a key; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_path, free_shuffles, new_path, text_of, written

GRAM = 16
NO_ID = (1 << 63) - 1
#: Bytes of text that are hashed together: what a core's cache holds.
_TOGETHER = 128_000
#: Suffixes that are sorted together, about.
_SUFFIXES = 200_000
#: Contents of one anchor that are sorted in one task, at most; more are taken by window.
CROWD = 20_000
_GROUPS = "ARRAY<STRUCT<group: BIGINT, offset: INT, length: INT, first: BIGINT>>"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of 16 bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M1
    for step in (1, 2, 4, 8):
        h = h[:-step] * _M2 + (h[step:] ^ (h[step:] >> np.uint64(29)))
    return (h ^ (h >> np.uint64(32))) * _M1


def anchor_runs(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each run of windows with one anchor, in one text or several."""
    grams = _gram_hashes(data)
    width = least - GRAM + 1
    # The place breaks ties to the left; it is below 2^24.
    low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.r_[0, cuts]
    return first, np.r_[cuts, len(at)] - 1, grams[at[first]]


def _runs(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, hash): runs of all texts, none over a border."""
    out, at = [], 0
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= _TOGETHER:
            size += len(texts[end])
            end += 1
        whole = np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8)
        for lo in range(0, max(1, size), 8_000_000):  # a very long text is taken in stretches
            data = whole[lo : lo + 8_000_000 + least - 1]
            if len(data) < least:
                continue
            first, last, h = anchor_runs(data, least)
            first, last = first + lo, last + lo
            bounds = np.cumsum(sizes[at:end])
            starts = bounds - sizes[at:end]
            # Windows may go over a border: a run is cut at each, and windows that cross are dropped.
            own = np.searchsorted(bounds, first, side="right")
            stop = np.searchsorted(bounds, last, side="right")
            parts = np.repeat(np.arange(len(first)), stop - own + 1)
            text = own[parts] + np.arange(len(parts)) - np.repeat(np.cumsum(stop - own + 1) - (stop - own + 1), stop - own + 1)
            a = np.maximum(first[parts], starts[text])
            b = np.minimum(last[parts], bounds[text] - least)
            good = a <= b
            out.append((text[good] + at, a[good] - starts[text[good]], b[good] - starts[text[good]], h[parts[good]]))
        at = end
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(least: int):
    """The distinct anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                texts = batch.slice(at, 1000).column(0).to_pylist()
                text, _, _, h = _runs(texts, least)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], ["anchor"])

    return run


def _placed(least: int, common: np.ndarray, parts: int):
    """All runs; part: 0, but for common anchors 1 to parts by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids = some.column(0).to_numpy()
                text, first, last, h = _runs(some.column(1).to_pylist(), least)
                own, anchor = ids[text], h.view(np.int64)
                part = np.where(np.isin(anchor, common), (own ^ (own >> 17)) % parts + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part), pa.array(own), pa.array(first << 8 | last - first)], ["anchor", "part", "id", "run"]
                )

    return run


def _hashed(least: int):
    """A 64-bit hash of each run's bytes, from the hashes of six of its grams, which together cover it."""
    names = ["anchor", "c1", "id", "start", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 40):
                some = batch.slice(at, 40)
                texts = some.column(1).to_pylist()
                starts = np.cumsum([0, *map(len, texts)])[:-1]
                grams = _gram_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
                lists = some.column(3)
                text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                runs = lists.flatten().to_numpy()
                first, size = runs >> 8, (runs & 255) + least
                place, last = starts[text] + first, size - GRAM
                h = size.astype(np.uint64) * _M1
                for step in (0, 16, 32, 48, 64):
                    h = (h ^ (h >> np.uint64(29))) * _M2 + grams[place + np.minimum(step, last)]
                h = (h ^ (h >> np.uint64(29))) * _M2 + grams[place + last]
                ids = some.column(0).to_numpy()[text]
                yield pa.RecordBatch.from_arrays(
                    [some.column(2).flatten(), pa.array(h.view(np.int64)), pa.array(ids), pa.array(first), pa.array(size.astype(np.int32))], names
                )

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contents: (text, items of anchor, c1, start, size, low, high, n) to a row a content."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            texts = some.column(0).to_pylist()
            starts = np.cumsum([0, *map(len, texts)])[:-1]
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            lists = some.column(1)
            text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten()
            part = dict(zip((f.name for f in items.type), items.flatten(), strict=True))
            first, size = part["start"].to_numpy(), part["size"].to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            # Byte by byte: from where each content's bytes come.
            place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[text] + first - (ends - size), size)
            offsets = pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes())
            contents = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(data[place].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part["anchor"], part["c1"], contents, part["low"], part["high"], part["n"]], ["anchor", "c1", "content", "low", "high", "n"]
            )


class SuffixArray:
    """Sorted suffixes of contents with common-prefix lengths; groups are sorted apart.

    Suffixes are those of `least` bytes or more that may have as much in common with another.
    """

    def __init__(self, contents: list[bytes], groups: np.ndarray, least: int):
        sizes = np.fromiter(map(len, contents), np.int64, len(contents))
        n = np.maximum(sizes - least + 1, 0)
        width = -(-int(sizes.max(initial=least)) // 8) * 8
        data = np.frombuffer(b"".join([*contents, bytes(width)]), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        content = np.repeat(np.arange(len(contents)), n)
        offset = np.arange(len(content)) - np.repeat(np.cumsum(n) - n, n)
        # A suffix whose first `least` bytes no other has, by a hash of them, is in no interval.
        grams = _gram_hashes(data)
        place = starts[content] + offset
        h = groups[content].astype(np.uint64) * _M1
        for step in (*range(0, least - GRAM, GRAM), least - GRAM):
            h = (h ^ (h >> np.uint64(29))) * _M2 + grams[place + step]
        slot = ((h ^ (h >> np.uint64(32))) * _M1 >> np.uint64(42)).astype(np.int64)
        met = (np.bincount(slot, minlength=1 << 22) > 1)[slot]
        self.content, self.offset, at = content[met], offset[met], place[met]
        self.rest = sizes[self.content] - self.offset
        # Beyond a content's end its bytes are 0, so that they tell nothing.
        self.bytes = data[at[:, None] + np.arange(width)]
        self.bytes[np.arange(width) >= self.rest[:, None]] = 0
        keys = self.bytes.view(">u8").astype(np.uint64)
        order = np.lexsort((self.rest, *keys.T[::-1], groups[self.content]))
        for name in ("content", "offset", "rest", "bytes"):
            setattr(self, name, getattr(self, name)[order])
        other = self.bytes[1:] != self.bytes[:-1]
        common = np.where(other.any(axis=1), other.argmax(axis=1), width)
        common = np.minimum(common, np.minimum(self.rest[1:], self.rest[:-1]))
        group = groups[self.content]
        common[group[1:] != group[:-1]] = 0
        self.common = np.r_[0, common, 0] if len(self.content) else np.zeros(1, dtype=np.int64)
        before = data[np.maximum(at - 1, 0)].astype(np.int64)[order]
        self.before = np.where(self.offset > 0, before, -1)


def interval_tree(common: list[int], least: int, low: list[int], high: list[int], before: list[int]) -> list[tuple[int, int, int, int, int, bool]]:
    """Common-prefix intervals of length `least` or more: (length, first, last, least id, greatest id, left-diverse).

    common[i] is the common prefix of suffixes i - 1 and i, 0 at both ends. A suffix whose run begins
    there (before -1) differs from all others on its left.
    """
    out, stack = [], []  # of [length, first, low, high, before or -1 if it differs]
    for i in range(1, len(common)):
        size = common[i]
        if size < least and not stack:
            continue
        j = i - 1
        node = [0, j, low[j], high[j], before[j]]
        while stack and stack[-1][0] > size:
            top = stack.pop()
            top[2], top[3] = min(top[2], node[2]), max(top[3], node[3])
            if top[4] != node[4]:
                top[4] = -1
            out.append((top[0], top[1], j, top[2], top[3], top[4] < 0))
            node = [0, *top[1:]]
        if size < least:
            continue
        if stack and stack[-1][0] == size:
            top = stack[-1]
            top[2], top[3] = min(top[2], node[2]), max(top[3], node[3])
            if top[4] != node[4]:
                top[4] = -1
        else:
            node[0] = size
            stack.append(node)
    return out


def _scan(contents: list[bytes], groups: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """(content, offset, length, group, least id) of every member of every maximal repeat of two documents or more.

    groups: the number of each content's anchor, ascending. A content that has its anchor alone needs
    no sorting: all its windows have the same occurrences, so it is the one maximal repeat.
    """
    new = np.r_[True, groups[1:] != groups[:-1], True]
    lone = new[:-1] & new[1:]
    shared = low != high
    out = [(k, 0, len(contents[k]), n, int(low[k])) for n, k in enumerate(np.flatnonzero(lone & shared).tolist())]
    rest = np.flatnonzero(~lone)
    if not len(rest):
        return out
    sa = SuffixArray([contents[k] for k in rest.tolist()], groups[rest], least)
    lo, hi = low[rest], high[rest]
    tree = interval_tree(sa.common.tolist(), least, lo[sa.content].tolist(), hi[sa.content].tolist(), sa.before.tolist())
    content, offset, group = rest[sa.content].tolist(), sa.offset.tolist(), len(out)
    for length, a, b, first, last, diverse in tree:
        if diverse and first != last:
            out += [(content[k], offset[k], length, group, first) for k in range(a, b + 1)]
            group += 1
    # A content of several documents is a repeat by itself, unless an inner node of the tree already is that string.
    size = np.array([len(contents[k]) for k in rest.tolist()])
    inner = np.zeros(len(rest), dtype=np.int64)
    heads = np.flatnonzero(sa.offset == 0)
    inner[sa.content[heads]] = np.maximum(sa.common[heads], sa.common[heads + 1])
    for k in np.flatnonzero((lo != hi) & (size > inner)).tolist():
        out.append((int(rest[k]), 0, int(size[k]), group, int(lo[k])))
        group += 1
    return out


def _grouped(least: int):
    kind = pa.list_(pa.struct([("group", pa.int64()), ("offset", pa.int32()), ("length", pa.int32()), ("first", pa.int64())]))

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        anchors = rows["anchor"].to_numpy()
        groups = np.cumsum(np.r_[True, anchors[1:] != anchors[:-1]])
        found = _scan(rows["content"].to_pylist(), groups, rows["low"].to_numpy(), rows["high"].to_numpy(), least)
        found = np.array(found, dtype=np.int64).reshape(-1, 5)
        found = found[np.argsort(found[:, 0], kind="stable")]
        at, first = np.unique(found[:, 0], return_index=True)
        # A group's number is its anchor's hash and its place within the batch, mixed.
        number = anchors[found[:, 0]] ^ ((found[:, 3].view(np.uint64) + np.uint64(1)) * _M1).view(np.int64)
        fields = [pa.array(number), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 4])]
        items = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(found)].astype(np.int32)), items)
        keys = [rows[k].chunk(0).take(pa.array(at)) if rows.num_rows else rows[k] for k in ("anchor", "c1")]
        return pa.RecordBatch.from_arrays([*keys, lists], ["anchor", "c1", "groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, 8000)
                at += some.num_rows
                if size > _SUFFIXES // 20:
                    # Give away all that has ended: up to the last change of anchor.
                    anchors = some.column(0).to_numpy()
                    last = held[-1].column(0)[-1].as_py()
                    change = np.flatnonzero(anchors != last)
                    if len(change):
                        held.append(some.slice(0, int(change[0])))
                        yield of(held)
                        held, size, some = [], 0, some.slice(int(change[0]))
                held.append(some)
                size += some.num_rows
        if held:
            yield of(held)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for first, text, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
            reach = -1
            for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                if a > reach:  # a new removed run; those that touch are one
                    kept.update(text[at:a])
                    spans += 1
                    removed += b - a
                    reach = at = b
                elif b > reach:
                    removed += b - reach
                    reach = at = b
            kept.update(text[at:])
            rows.append((first, removed, spans, kept.hexdigest()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["first", "removed", "spans", "sha256"])


class Repeats:
    """Maximal repeats of a corpus: `groups`, `occurrences` and the written `texts`."""

    def __init__(self, docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD):
        spark = docs.sparkSession
        self.spark, self.least = spark, least
        buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).cast("binary").alias("text"))
        digest = F.unhex(F.sha2("text", 256)).alias("digest")
        self.rows = written(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), digest), "repeat-rows")
        self.firsts = written(self.rows.groupBy("digest").agg(F.min("id").alias("first")), "repeat-firsts")
        # Long texts only, and each once.
        named = rows.where(F.octet_length("text") >= least)
        named = named.join(self.firsts.select("first").hint("merge"), F.col("id") == F.col("first")).select("first", "text")
        self.name, self.path = f"repeat_texts_{uuid.uuid4().hex}", new_path(spark, "repeat-texts")
        named.write.bucketBy(buckets, "first").sortBy("first").format("parquet").option("compression", "zstd").saveAsTable(self.name, path=self.path)
        self.texts = spark.table(self.name)
        free_shuffles(spark)

        placed = self.texts.select("first", "text").mapInArrow(
            _placed(least, self._common(), buckets), "anchor BIGINT, part INT, id BIGINT, run BIGINT"
        )
        same = Window.partitionBy("anchor", "part")
        placed = placed.withColumn("low", F.min("id").over(same)).withColumn("high", F.max("id").over(same))
        placed = placed.where("part > 0 OR low <> high").groupBy("id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("run").alias("runs"))
        passing: list[str] = []
        placed = written(placed, "repeat-runs", passing)
        free_shuffles(spark)
        cut = self.texts.join(placed, self.texts["first"] == placed["id"]).select("id", "text", "anchors", "runs")
        cut = cut.mapInArrow(_hashed(least), "anchor BIGINT, c1 BIGINT, id BIGINT, start BIGINT, size INT")
        self.occurrences = written(cut, "occurrences")
        drop_path(spark, passing.pop())
        where = F.min(F.struct("id", "start", "size")).alias("at")
        contents = self.occurrences.groupBy("anchor", "c1").agg(where, F.max("id").alias("high"))
        contents = contents.select("anchor", "c1", F.col("at.id").alias("low"), "high", F.col("at.start").alias("start"), F.col("at.size").alias("size"))
        contents = written(contents, "contents")
        free_shuffles(spark)
        several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        several = written(several, "anchors-several")
        # A content that has its anchor alone is the one maximal repeat of all its windows.
        lone = contents.join(several, "anchor", "left_anti").where("low <> high")
        whole = F.array(F.struct(F.col("anchor").alias("group"), F.lit(0).alias("offset"), F.col("size").alias("length"), F.col("low").alias("first")))
        item = F.struct("anchor", "c1", "start", "size", "low", "high", "n")
        wanted = contents.join(several, "anchor").groupBy("low").agg(F.collect_list(item).alias("items"))
        wanted = self.texts.join(wanted, self.texts["first"] == wanted["low"]).select("text", "items")
        wanted = wanted.mapInArrow(_cut_out, "anchor BIGINT, c1 BIGINT, content BINARY, low BIGINT, high BIGINT, n BIGINT")
        wanted = written(wanted, "contents-bytes", passing)
        free_shuffles(spark)
        calm = wanted.where(F.col("n") <= crowd).drop("n").repartition("anchor").sortWithinPartitions("anchor", "c1")
        found = calm.mapInArrow(_grouped(least), f"anchor BIGINT, c1 BIGINT, groups {_GROUPS}")
        found = written(found, "repeat-groups")
        found = found.unionByName(self._windows(wanted.where(F.col("n") > crowd)))
        drop_path(spark, passing.pop())
        self.groups = found.unionByName(lone.select("anchor", "c1", whole.cast(_GROUPS).alias("groups")))
        free_shuffles(spark)

    def _common(self) -> np.ndarray:
        """Anchors that a thousandth of the texts have, or more, by a sample of a 64th of them.

        They are repeated, and their runs needn't meet in one task to tell. A thousand times a text's
        mean number of anchors bounds how many there are.
        """
        some = self.texts.where(F.pmod(F.xxhash64(F.lit("sample"), "first"), F.lit(64)) == 0)
        often = max(8, some.count() // 1000)
        counts = some.select("text").mapInArrow(_anchors(self.least), "anchor BIGINT").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        return np.array(sorted(r["anchor"] for r in counts.where(F.col("n") >= often).select("anchor").collect()), dtype=np.int64)

    def _windows(self, contents: DataFrame) -> DataFrame:
        """The groups of contents whose anchor has too many for a task: each window is a string of its own.

        These repeats are `least` bytes long and overlap; windows are known by 128 bits of hash.
        """
        least = self.least
        windows = F.transform(
            F.sequence(F.lit(0), F.octet_length("content") - least),
            lambda i: F.struct(
                i.alias("offset"),
                F.xxhash64(F.substring(F.col("content"), i + 1, F.lit(least))).alias("w1"),
                F.xxhash64(F.lit("second"), F.substring(F.col("content"), i + 1, F.lit(least))).alias("w2"),
            ),
        )
        rows = contents.select("anchor", "c1", "low", "high", F.explode(windows).alias("w"))
        rows = written(rows.select("anchor", "c1", "low", "high", "w.*"), "windows")
        shared = rows.groupBy("w1", "w2").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first <> last")
        shared = written(shared.select("w1", "w2", "first"), "windows-shared")
        rows = rows.join(shared, ["w1", "w2"])
        member = F.struct(F.col("w1").alias("group"), "offset", F.lit(least).alias("length"), "first")
        return written(rows.groupBy("anchor", "c1").agg(F.collect_list(member).alias("groups")), "repeat-windows")

    def close(self) -> None:
        """Drops the written texts; the other tables stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)

    def members(self) -> DataFrame:
        """(group, id, start, length): every occurrence of every maximal repeat group."""
        rows = self.occurrences.select("anchor", "c1", "id", "start").join(self.groups.hint("shuffle_hash"), ["anchor", "c1"])
        rows = rows.select("id", "start", F.explode("groups").alias("g"))
        return rows.select("g.group", "id", (F.col("start") + F.col("g.offset")).alias("start"), "g.length")

    def removed(self) -> DataFrame:
        """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; bytes also in a document of smaller id are removed."""
        rows = self.occurrences.select("anchor", "c1", "id", "start").join(self.groups.hint("shuffle_hash"), ["anchor", "c1"])
        earlier = F.filter("groups", lambda g: g["first"] < F.col("id"))
        rows = rows.select("id", "start", earlier.alias("groups")).where(F.size("groups") > 0)
        starts = F.transform("groups", lambda g: F.col("start") + g["offset"])
        ends = F.transform("groups", lambda g: F.col("start") + g["offset"] + g["length"])
        spans = rows.select("id", starts.alias("starts"), ends.alias("ends"))
        spans = spans.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
        spans = written(spans, "repeat-spans")
        free_shuffles(self.spark)
        kept = self.texts.join(spans, self.texts["first"] == spans["id"], "left").select("first", "text", "starts", "ends")
        kept = kept.mapInArrow(_removed, "first BIGINT, removed BIGINT, spans BIGINT, sha256 STRING")
        kept = written(self.firsts.join(kept, "first").dropDuplicates(["first"]), "repeat-kept")
        whole = self.rows.join(kept, "digest", "left")
        own, empty = F.col("id") == F.col("first"), hashlib.sha256().hexdigest()
        # Texts that are too short keep all; copies keep nothing.
        return whole.select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
            "n_bytes",
            F.when(F.col("first").isNull(), 0).when(own, F.col("removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
            F.when(F.col("first").isNull(), 0).when(own, F.col("spans")).otherwise(1).cast("long").alias("n_spans"),
            F.when(F.col("first").isNull(), F.lower(F.hex("digest"))).when(own, F.col("sha256")).otherwise(empty).alias("kept_sha256"),
        )


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repeats(documents(spark, sf_dir)).removed()
