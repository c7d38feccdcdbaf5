"""Toxicity by class-conditional Kneser-Ney models of words' letters.

Two interpolated Kneser-Ney models, of toxic and of ordinary documents, give each letter of a word
its probability after the letters before it. Orders above SHARED have counts by class; those below
pool both classes, so that a rare expression is smoothed by the same counts in both models and tells
nothing by itself. A word's evidence is the difference of its log-likelihoods, toxic less ordinary,
also taken per letter; a document's is the highest of its words, the mean of its three highest and
the mean per letter of the whole text, so that length neither helps nor hides. A logistic
curve, fitted on labelled documents that the counts don't include, makes it a score.

Bound: `sample` is the number of labelled documents of each class that are expected to be learnt
from, half for the counts and half for the curve, chosen by a hash of their id. Scores are taken
over all of every text.

Defined results: a null or empty text, or one without letters, scores as a text without evidence; if
one class has no labelled document every score is 0; a document labelled more than once is toxic if
any label says so; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, table, text_of
from .language import LONGEST, _by_length, _chunks, held_out, runs

ORDER = 6
SHARED = 2
DISCOUNT = 0.75
ROOM = 400_000
#: The score that calls a document toxic.
LEVEL = 0.7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEN_BITS = 22


def words_of(part: str) -> list[str]:
    """The words of what white space parts, with signs for their start and end."""
    return [f"^{run[i : i + LONGEST]}$" for run in runs(part) for i in range(0, len(run), LONGEST)]


def _chars(words: list[str]) -> np.ndarray:
    return np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


def _grams(chars: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many characters: row by word, column by start."""
    h = np.full((len(chars), chars.shape[1] - size + 1), np.uint64(size))
    for k in range(size):
        h = h * _BASE + chars[:, k : chars.shape[1] - size + 1 + k]
    return h ^ (h >> np.uint64(29))


class _Table:
    """Numbers by hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.__setstate__((keys[order], values[order].astype(np.float32)))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, self.values

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.values = state
        self.seen = np.zeros(1 << _SEEN_BITS, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - _SEEN_BITS)] = True

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes that are there stand, and their numbers."""
        may = np.flatnonzero(self.seen[h >> np.uint64(64 - _SEEN_BITS)])
        if not len(may):
            return may, np.zeros(0, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        good = self.keys[at] == h[may]
        return may[good], self.values[at[good]]


class KneserNey:
    """Log-likelihood differences of two interpolated Kneser-Ney models over letters."""

    def __init__(self, words: tuple[list[str], list[str]], counts: tuple[np.ndarray, np.ndarray], order: int = ORDER, shared: int = SHARED):
        """words and how often, ordinary then toxic."""
        raw: list[dict[str, np.ndarray]] = []
        for size in range(1, order + 1):
            parts = {"gram": [], "context": [], "suffix": [], "n": [], "first": [], "toxic": []}
            for toxic in (0, 1):
                for at, some in _by_length(words[toxic]):
                    chars = _chars(some)
                    if chars.shape[1] < size:
                        continue
                    gram = _grams(chars, size)
                    starts = gram.shape[1]
                    none = np.zeros_like(gram)
                    parts["gram"].append(gram.ravel())
                    parts["context"].append((_grams(chars, size - 1)[:, :starts] if size > 1 else none).ravel())
                    parts["suffix"].append((_grams(chars, size - 1)[:, 1 : starts + 1] if size > 1 else none).ravel())
                    parts["n"].append(np.repeat(counts[toxic][at].astype(float), starts))
                    parts["first"].append(np.tile(np.arange(starts) == 0, len(some)))
                    parts["toxic"].append(np.full(gram.size, toxic))
            raw.append({k: np.concatenate(v) if v else np.zeros(0, dtype=np.uint64) for k, v in parts.items()})
        self.order, self.grams, self.backoffs = order, [], []
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for size in range(1, order + 1):
            r = raw[size - 1]
            keys, first, back = np.unique(r["gram"], return_index=True, return_inverse=True)
            n = np.zeros((2, len(keys)))
            if size == order:
                kept = np.ones(len(back), dtype=bool)
            else:  # the counts of lower orders are of different letters before, but for runs that start words
                kept = r["first"]
                up = raw[size]
                ones = np.unique(np.stack([up["gram"], up["toxic"].astype(np.uint64)]), axis=1, return_index=True)[1]
                np.add.at(n, (up["toxic"][ones].astype(int), np.searchsorted(keys, up["suffix"][ones])), 1)
            np.add.at(n, (r["toxic"][kept].astype(int), back[kept]), r["n"][kept])
            if size <= shared:
                n = np.stack([n.sum(axis=0)] * 2)
            contexts, owner = np.unique(r["context"][first], return_inverse=True)
            total, kinds = np.zeros((2, len(contexts))), np.zeros((2, len(contexts)))
            for c in (0, 1):
                total[c] = np.bincount(owner, n[c], minlength=len(contexts))
                kinds[c] = np.bincount(owner, np.minimum(n[c], DISCOUNT), minlength=len(contexts))
            weight = np.where(total > 0, kinds / np.maximum(total, 1e-9), 1.0)
            below = np.full((2, len(keys)), 1 / 256) if lower is None else lower[1][:, np.searchsorted(lower[0], r["suffix"][first])]
            p = np.maximum(n - DISCOUNT, 0) / np.maximum(total[:, owner], 1e-9) + weight[:, owner] * below
            lower = (keys, p)
            self.grams.append(_Table(keys, np.log(p[1] / p[0])))
            self.backoffs.append(_Table(contexts, np.log(weight[1] / weight[0])))

    def score(self, words: list[str]) -> np.ndarray:
        """The difference for each word, toxic less ordinary."""
        out = np.zeros(len(words))
        for at, some in _by_length(words):
            chars = _chars(some)
            n, total = chars.shape[1], np.zeros(chars.shape)
            open_ = np.ones(chars.shape, dtype=bool)
            open_[:, 0] = False
            for size in range(min(self.order, n), 0, -1):
                todo = open_[:, size - 1 :]
                rows, starts = np.nonzero(todo)
                grams = _grams(chars, size)[rows, starts]
                hit, value = self.grams[size - 1].get(grams)
                total[rows[hit], starts[hit] + size - 1] += value
                open_[rows[hit], starts[hit] + size - 1] = False
                if size > 1:
                    miss = np.ones(len(rows), dtype=bool)
                    miss[hit] = False
                    rows, starts = rows[miss], starts[miss]
                    hit, value = self.backoffs[size - 1].get(_grams(chars, size - 1)[rows, starts])
                    total[rows[hit], starts[hit] + size - 1] += value
            out[at] = total.sum(axis=1)
        return out


class _Scorer:
    """Evidence of texts in a worker; keeps that of what it has seen."""

    def __init__(self, model: KneserNey):
        self.model, self.known = model, {}
        self.rows = np.zeros((0, 3))

    def _learn(self, parts: set[str]) -> None:
        if len(self.known) > ROOM:
            self.known.clear()
            self.rows = self.rows[:0]
        new = [p for p in parts if p not in self.known]
        words = [words_of(p) for p in new]
        flat = [w for ws in words for w in ws]
        found = self.model.score(flat)
        owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, words), np.int64, len(words)))
        rows = np.zeros((len(new), 3))  # highest word, sum, letters
        np.maximum.at(rows[:, 0], owner, found)
        rows[:, 1] = np.bincount(owner, found, minlength=len(new))
        rows[:, 2] = np.bincount(owner, np.fromiter(map(len, flat), np.int64, len(flat)) - 2, minlength=len(new))
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, rows])

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: the highest word, the mean of the three highest, the mean per letter of all."""
        cut = [t.lower().split() for t in texts]
        self._learn(set().union(*cut))
        get, out = self.known.__getitem__, np.zeros((len(texts), 3))
        for i, c in enumerate(cut):
            found = self.rows[np.fromiter(map(get, c), np.int64, len(c))]
            if len(found):
                high = found[:, 0]
                top = np.sort(high if len(high) <= 3 else np.partition(high, len(high) - 3)[-3:])
                out[i] = top[-1], top.mean(), found[:, 1].sum() / max(1.0, found[:, 2].sum())
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve, with both classes weighing the same, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


class Model:
    def __init__(self, letters: KneserNey | None, curve: np.ndarray | None):
        self.letters, self.curve = letters, curve

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[evidence, np.ones(len(evidence))] @ self.curve, -30, 30)))


def _scored(shared, key: str, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = held("toxicity", key, lambda: _Scorer(model.letters))
        for batch in batches:
            for some in _chunks(batch):
                found = scorer.evidence(some.column(1).to_pylist())
                if final:
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(model.scores(found))], ["doc_id", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(found[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = 1200, where: Column | None = None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of the rows that `where` admits."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.where(where) if where is not None else marked
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(None, None)
    share = F.when(F.col("toxic") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(sample / sizes[0]))
    chosen = marked.where(F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    # At most two samples' worth of ids, by the parameter.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("toxic", text_of().alias("text"), "half")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _chunks(batch):
                pairs = zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
                flat = [(y, w) for y, t in pairs for w in {w for part in set(t.lower().split()) for w in words_of(part)}]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in flat], pa.int32()), pa.array([w for _, w in flat], pa.string())], ["toxic", "word"])

    counted = rows.where("half = 0").select("toxic", "text").mapInArrow(words, "toxic INT, word STRING")
    counted = counted.groupBy("toxic", "word").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["toxic", "word"])
    by = [counted[counted["toxic"] == c] for c in (0, 1)]
    letters = KneserNey(tuple(b["word"].tolist() for b in by), tuple(b["n"].to_numpy() for b in by))
    model = Model(letters, None)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = rows.where("half = 1").select("toxic", "text").mapInArrow(_scored(shared, uuid.uuid4().hex, False), "toxic INT, a DOUBLE, b DOUBLE, c DOUBLE")
    seen = seen.toPandas().sort_values(["toxic", "a", "b", "c"]).to_numpy(dtype=float)
    model.curve = fit_curve(seen[:, 1:], seen[:, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if model.letters is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared, uuid.uuid4().hex, True), "doc_id BIGINT, score DOUBLE")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, table(spark, sf_dir, "labels"), where=~held_out(3, 1))
    rows = score(docs, model)
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= LEVEL, 1).otherwise(0).alias("predicted"))
