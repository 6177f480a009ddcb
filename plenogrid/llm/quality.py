"""A quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: of three bytes of the lower-cased text
(``bytes``), of one to four bytes of its *shape*, in which letters, digits and
blanks are folded into one byte a run (``shape``), of one to four marks of whether
a word repeats the one before it (``marks``), and of one and two words
(``words``).  They are hashed to 65,536 columns.  Which of these kinds are used,
``KINDS``, was chosen by ``cross_validate``, which sees training folds only.
Each indicator is scaled by its class log-count ratio, documents are scaled to
length one, and a linear hinge-loss model is fitted by dual coordinate descent
(Wang and Manning 2012; Hsieh et al. 2008).

The fit uses at most ``SAMPLE`` labelled rows, those of smallest hash of their
id: a documented bound, so that the sample, the counts over it and the model,
one number a column, fit in one place at any corpus size; a row holds 8 kB at
most, whatever its text.  Scoring is one pass over all
texts without a shuffle.

Defined results: a null or empty text has no features and gets the score of the
intercept; a null id is not held out and has no label; if an id has several
labels the largest counts; without labels of both classes every score follows
the only class, or is 0.5 where there is none; extra columns are ignored by
``score`` and kept by ``keep_good``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash as H
from .common import table

COLUMNS, SAMPLE, FOLDS, HELD_OUT = 1 << 16, 8000, 3, 1
#: The kinds of features in use.
KINDS = ("shape", "marks", "words")
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123] = _FOLD[128:] = ord("a")
_FOLD[48:58] = ord("0")
_FOLD[[9, 11, 12, 13]] = ord(" ")
_RUN = np.zeros(256, bool)
_RUN[[ord("a"), ord("0"), ord(" ")]] = True


def _columns(code: np.ndarray, kind: int) -> np.ndarray:
    return (H.mix(code + _U(kind << 40)) >> _U(48)).astype(np.int64)


def features(buf: np.ndarray, off: np.ndarray, kinds: tuple[str, ...] = KINDS) -> np.ndarray:
    """Sorted distinct ``row * COLUMNS + column`` of the texts in the buffer."""
    n = len(off) - 1
    seen = np.zeros(n * COLUMNS, bool)
    low = H._LOWER[buf]

    def mark(code: np.ndarray, row: np.ndarray, k: int, kind: int) -> None:
        """Note codes that end k places behind their start, where both lie in one row."""
        same = row[k:] == row[: len(row) - k]
        seen[(row[k:] * COLUMNS + _columns(code, kind))[same]] = True

    def grams(code: np.ndarray, row: np.ndarray, bits: int, kind: int) -> None:
        """Note one to four codes in a row."""
        whole = np.zeros(len(code), _U)
        for k in range(min(4, len(code))):
            whole = (whole[: len(code) - k] << _U(bits)) | code[k:]
            mark(whole, row, k, kind + k)

    byte_row = np.repeat(np.arange(n), np.diff(off))
    if "bytes" in kinds and len(low) > 2:
        wide = low.astype(_U)
        mark(wide[2:] | wide[1:-1] << _U(8) | wide[:-2] << _U(16), byte_row, 2, 9)
    if "shape" in kinds:
        shape = _FOLD[buf]
        keep = np.ones(len(shape), bool)
        keep[1:] = ~_RUN[shape[1:]] | (shape[1:] != shape[:-1]) | (byte_row[1:] != byte_row[:-1])
        grams(shape[keep].astype(_U), byte_row[keep], 8, 0)
    if "marks" in kinds or "words" in kinds:
        _, s, e, first = H.words(buf, off)
        word, row = H.spans(H.prefix(low), s, e), np.repeat(np.arange(n), np.diff(first))
        if "marks" in kinds and len(word):
            repeats = np.ones(len(word), _U)
            repeats[1:] += (word[1:] == word[:-1]) & (row[1:] == row[:-1])
            grams(repeats, row, 2, 20)
        if "words" in kinds and len(word):
            mark(word, row, 0, 30)
            mark(word[1:] + H.mix(word[:-1]), row, 1, 31)
    return np.flatnonzero(seen)


def _rows(column: pa.Array, kinds: tuple[str, ...] = KINDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature from 0, column of each feature)."""
    for lo, hi, buf, off in H.chunks(column, 1 << 20, 256):
        f = features(buf, off, kinds)
        yield lo, hi, f // COLUMNS, f % COLUMNS


@dataclass
class Model:
    """score = 1 / (1 + exp(-(sum of weight / sqrt(sum of scale) + intercept))) over a document's columns."""

    weight: np.ndarray
    scale: np.ndarray
    intercept: float

    def scores(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(row, self.weight[column], n)
        norm = np.sqrt(np.bincount(row, self.scale[column], n))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(norm, 1e-12) + self.intercept, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 2.0, rounds: int = 20, smooth: float = 1.0) -> Model:
    """NB-SVM by dual coordinate descent on documents given as arrays of columns."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(COLUMNS), np.ones(COLUMNS), float(y[0]) * 4 if len(y) else 0.0)
    counts = [np.full(COLUMNS, smooth), np.full(COLUMNS, smooth)]
    for r, positive in zip(rows, y > 0, strict=True):
        counts[int(positive)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # A row is its columns and one factor; its scaled values are taken from the ratios when they are needed.
    scale = np.array([1 / max(1e-12, np.sqrt(np.square(ratio[r]).sum())) for r in rows])
    w, b, alpha = np.zeros(COLUMNS), 0.0, np.zeros(len(y))
    square = np.array([np.square(ratio[r] * s).sum() for r, s in zip(rows, scale, strict=True)]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(y)):
            unit = ratio[rows[i]] * scale[i]
            gradient = y[i] * (w[rows[i]] @ unit + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            change = (new - alpha[i]) * y[i]
            if change:
                alpha[i] = new
                w[rows[i]] += change * unit
                b += change
                largest = max(largest, abs(change))
        if largest < 1e-3:
            break
    return Model(w * ratio, np.square(ratio), b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _pack(columns: np.ndarray) -> bytes:
    """Columns as numbers of two bytes, or as a bit map where that is not longer."""
    if 2 * len(columns) < COLUMNS // 8:
        return columns.astype(np.uint16).tobytes()
    bits = np.zeros(COLUMNS, bool)
    bits[columns] = True
    return np.packbits(bits).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    if len(packed) < COLUMNS // 8:
        return np.frombuffer(packed, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8))).astype(np.uint16)


def _encode(kinds: tuple[str, ...]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, row, column in _rows(batch.column("text"), kinds):
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                out += [_pack(column[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "columns"])

    return apply


def _labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, label, columns) of the training folds' labelled rows, at most ``sample`` of them."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    rows = texts.mapInArrow(_encode(kinds), "doc_id long, label int, columns binary").groupBy("doc_id").agg(F.max(F.struct("columns", "label")).alias("r"))
    return [(r["doc_id"], r["r"]["label"], _unpack(r["r"]["columns"])) for r in sorted(rows.toArrow().to_pylist(), key=lambda r: r["doc_id"])]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the training folds' labelled rows, at most ``sample`` of them."""
    rows = _labelled(docs, labels, label, sample)
    return fit([columns for _, _, columns in rows], np.array([y for _, y, _ in rows]))


def cross_validate(docs: DataFrame, labels: DataFrame, kinds: tuple[str, ...] = KINDS, label: str = "quality", sample: int = SAMPLE, parts: int = 5) -> float:
    """Accuracy of models of these kinds of features within the training folds: each fifth is judged by a fit on the others."""
    rows = _labelled(docs, labels, label, sample, kinds)
    order = np.random.default_rng(3).permutation(len(rows))
    right = 0
    for part in range(parts):
        test = set(order[part::parts].tolist())
        some = [r for k, r in enumerate(rows) if k not in test]
        model = fit([c for _, _, c in some], np.array([y for _, y, _ in some]))
        for k in test:
            _, y, columns = rows[k]
            right += int((model.scores(np.zeros(len(columns), np.int64), columns, 1)[0] >= 0.5) == (y > 0))
    return right / max(1, len(rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, row, column in _rows(batch.column("text")):
                out[lo:hi] = model.scores(row, column, hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, with all their columns."""
    names, position = docs.columns, [c.lower() for c in docs.columns].index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo, hi, row, column in _rows(batch.column(position)):
                good[lo:hi] = model.scores(row, column, hi - lo) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(apply, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
