"""Language identification by unigram pieces, summed over all segmentations.

The pieces are the fixed vocabulary of a public tokenizer. Each language has a probability for each
piece, learnt by expectation-maximisation from words of a bounded sample of labelled documents. A
word's probability is the sum over all ways to cut it into pieces, by the forward algorithm; a
text's is the product over its words. The prediction is the likeliest language under equal priors
and the score its posterior probability.

Words are runs of letters, in lower case, with a word-start sign before them. They are scored in
numpy, all words of one length at once, and kept by worker, so that a word is mostly scored once.

Bound: `sample` is the number of documents of each language that are expected to be learnt from;
they are chosen by a hash of their id. Everything else covers all texts whole.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing could be
learnt; ties go to the first language in order; a run of more than 40 letters is scored in pieces
of 40; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, text_of, written
from .encode import tokenizer_path

START = "▁"
LONGEST = 40
ROOM = 250_000
_RUNS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The plain pieces of a sentencepiece file: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Pieces:
    """Finds which pieces stand where in words."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for i, p in enumerate(pieces):
            h = np.zeros(1, dtype=np.uint64)
            for c in p:
                h = h * _BASE + np.uint64(ord(c) + 1)
            hashes[i] = h[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.longest = max(map(len, pieces))
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self._slot(hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(31))) & np.uint64((1 << 22) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 if none."""
        out = np.full(len(h), -1, dtype=np.int64)
        may = np.flatnonzero(self.seen[self._slot(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
        good = self.hashes[at] == h[may]
        out[may[good]] = self.order[at[good]]
        return out

    def spans(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, pieces) for words of one length: where which rows have a piece."""
        chars = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        n, out = chars.shape[1], []
        h = np.zeros_like(chars)
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, : n - size + 1] * _BASE + chars[:, size - 1 :]
            found = self.find(h.ravel()).reshape(h.shape)
            for start in range(n - size + 1):
                rows = np.flatnonzero(found[:, start] >= 0)
                if len(rows) or size == 1:
                    out.append((start + size, size, rows, found[rows, start]))
        return sorted(out, key=lambda x: x[0])

    def forward(self, words: list[str], probs: np.ndarray, unknown: float) -> tuple[list, np.ndarray]:
        """Spans and alpha[end, word, language] of words of one length; a lone character without a piece costs unknown."""
        spans, n = self.spans(words), len(words[0])
        alpha = np.zeros((n + 1, len(words), probs.shape[1]))
        alpha[0] = 1
        for end, size, rows, pieces in spans:
            if size == 1:
                other = np.ones(len(words), dtype=bool)
                other[rows] = False
                alpha[end, other] += alpha[end - 1, other] * unknown
            if len(rows) == len(words):
                alpha[end] += alpha[end - size] * probs[pieces]
            else:
                alpha[end, rows] += alpha[end - size, rows] * probs[pieces]
        return spans, alpha

    def score(self, words: list[str], probs: np.ndarray, unknown: float) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), probs.shape[1]), dtype=np.float64)
        for at, some in _by_length(words):
            out[at] = np.log(self.forward(some, probs, unknown)[1][-1])
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray, unknown: float) -> np.ndarray:
        """Expected counts of the pieces in words of one language, each counted so often."""
        total = np.zeros(len(self.pieces))
        for at, some in _by_length(words):
            spans, alpha = self.forward(some, probs, unknown)
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            weight = counts[at] / alpha[-1, :, 0]
            for end, size, rows, pieces in reversed(spans):
                start = end - size
                if size == 1:
                    other = np.ones(len(some), dtype=bool)
                    other[rows] = False
                    beta[start, other] += beta[end, other] * unknown
                p = probs[pieces, 0]
                beta[start, rows, 0] += beta[end, rows, 0] * p
                total += np.bincount(pieces, alpha[start, rows, 0] * p * beta[end, rows, 0] * weight[rows], minlength=len(total))
        return total


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(words) else ():
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            yield some, [words[k] for k in some.tolist()]


def runs(part: str) -> list[str]:
    """The runs of letters in what white space parts; signs such as ½ or ² are no letters."""
    found = _RUNS.findall(part)
    if all(map(str.isalpha, found)):
        return found
    return [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]


def letters(part: str) -> list[str]:
    """The words of what white space parts."""
    return [START + run[i : i + LONGEST] for run in runs(part) for i in range(0, len(run), LONGEST)]


class Model:
    """Languages and the probability of each piece in each."""

    def __init__(self, path: str, languages: list[str], probs: np.ndarray, unknown: float = 1e-7):
        self.path, self.languages, self.probs, self.unknown = path, languages, probs, unknown


class _Scorer:
    """Scores texts in a worker; keeps the scores of what it has seen."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(vocabulary(model.path))
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages) + 1))

    def _learn(self, parts: set[str]) -> None:
        if len(self.known) > ROOM:
            self.known.clear()
            self.scores = self.scores[:0]
        new = [p for p in parts if p not in self.known]
        words = [letters(p) for p in new]
        flat = [w for ws in words for w in ws]
        found = self.pieces.score(flat, self.model.probs, self.model.unknown)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.zeros((len(new), self.scores.shape[1]))
        owner = np.repeat(np.arange(len(new)), sizes)
        for k in range(found.shape[1]):
            rows[:, k] = np.bincount(owner, found[:, k], minlength=len(new))
        rows[:, -1] = sizes
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, rows])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        cut = [t.lower().split() for t in texts]
        self._learn(set().union(*cut))
        get, out = self.known.__getitem__, []
        for c in cut:
            total = self.scores[np.fromiter(map(get, c), np.int64, len(c))].sum(axis=0)
            if not total[-1] or not self.model.languages:
                out.append(("und", 0.0))
                continue
            odds = np.exp(total[:-1] - total[:-1].max())
            best = int(np.argmax(odds))
            out.append((self.model.languages[best], float(odds[best] / odds.sum())))
        return out


def _chunks(batch: pa.RecordBatch, bytes_: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (id, text) with about so many bytes of text."""
    sizes = np.diff(np.r_[0, np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)])])
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size > bytes_:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def predict_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs and the struct `language` (lang_pred, score): decisions by row, without a join."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    rows = docs.withColumn("language", F.lit(None).cast("struct<lang_pred:string,score:double>"))
    at = rows.columns.index("language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held("language", key, lambda: _Scorer(shared.value))
        for batch in batches:
            texts, found = batch.column(batch.schema.names.index(text_col)), []
            for some in _chunks(pa.RecordBatch.from_arrays([texts, texts], ["id", "text"])):
                found += scorer.predict([t or "" for t in some.column(1).to_pylist()])
            columns = list(batch.columns)
            columns[at] = pa.array([{"lang_pred": k, "score": s} for k, s in found], kind)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held("language", key, lambda: _Scorer(shared.value))
        for batch in batches:
            for some in _chunks(batch):
                found = scorer.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def learn(
    docs: DataFrame, sample: int = 1500, rounds: int = 3, path: str | None = None, where: Column | None = None
) -> Model:
    """A model from docs (doc_id, text, lang): of each language about `sample` of the documents that `where` admits.

    The vocabulary times the languages bounds what comes to the driver.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    pieces = vocabulary(path)
    rows = docs.where(F.col("lang").isNotNull())
    rows = rows.where(where) if where is not None else rows
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    probs = np.full((len(pieces), max(1, len(languages))), 1 / len(pieces))
    if not languages:
        return Model(path, [], probs)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(sample / n)) for k, n in sizes.items()))
    chosen = F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            for some in _chunks(pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)):
                counts: dict[str, Counter] = {}
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    counts.setdefault(lang, Counter()).update(w for part in text.lower().split() for w in letters(part))
                flat = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), x, strict=True)) for x in flat], batch_schema)

    batch_schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    counted = rows.where(chosen).select("lang", text_of().alias("text")).mapInArrow(words, "lang STRING, word STRING, n BIGINT")
    counted = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    for _ in range(rounds):
        now = docs.sparkSession.sparkContext.broadcast(probs)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            finder = held("pieces", path, lambda: Pieces(vocabulary(path)))
            total = np.zeros((len(languages), len(finder.pieces)))
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), dtype=object)
                found, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, lang in enumerate(languages):
                    at = np.flatnonzero(langs == lang)
                    total[k] += finder.expected([found[i] for i in at.tolist()], n[at].astype(float), now.value[:, k : k + 1], 1e-7)
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["k", "piece", "n"])

        sums = counted.mapInArrow(expect, "k BIGINT, piece BIGINT, n DOUBLE").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        total = np.full((len(pieces), len(languages)), 0.01)
        for r in sums.collect():
            total[r["piece"], r["k"]] += r["n"]
        # Sums come in any order: round off what that changes.
        probs = np.round(total, 6) / np.round(total, 6).sum(axis=0)
    return Model(path, languages, probs)


def held_out(n: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that rest."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == rest, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, where=~held_out(4, 2))
    return predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
