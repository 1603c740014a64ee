"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of document statistics (byte classes, words, lines, repeats), transformed to logarithms
and log-odds so that a normal density fits. Class covariances are shrunk towards the pooled one and towards a
multiple of the identity; their Cholesky factors are kept, so a score is two triangular products: the difference
of the classes' log densities by Mahalanobis distance, calibrated to a probability.

Edge cases: null or empty text has the statistics of no bytes, and gets a score like any other; null ids keep their
row with a null ``held_out`` flag read as not held out; repeated rows are scored row by row; without labels of both classes every
score is 0.5; further columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.labelled import fold, labelled_sample, logistic, platt
from strandgraph.llm.shared import NON_SPACE, TextBatch, hash_spans, make_room

#: At most so many labelled documents are fitted on.
SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
#: Shares of the pooled covariance and of the scaled identity in a class covariance.
TO_POOLED, TO_IDENTITY = 0.15, 0.02

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\n\x0b\x0c",
    "stop": b".,;:?'\"",
    "mark": b"!",
    "symbol": b"#$%&*+=~^@",
    "bracket": b"|<>[]{}()/\\_-`",
    "high": bytes(range(128, 256)),
}
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBERS[list(_bytes), _k] = 1
N_FEATURES = 6 + len(_CLASSES) + 6


def _odds(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log((count + 0.5) / (np.maximum(total - count, 0) + 0.5))


def _spread(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of values over consecutive runs; runs may be empty."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of statistics for each text."""
    make_room()
    batch, rows = TextBatch(column), []
    for lo, hi, n_words, hashes, starts, ends in batch.words(NON_SPACE):
        n, begin = hi - lo, int(batch.offsets[lo])
        raw = batch.data[begin : int(batch.offsets[hi])]
        size = np.diff(batch.offsets[lo : hi + 1])
        row_of_byte = np.repeat(np.arange(n), size)
        hist = np.bincount(row_of_byte * 256 + raw, minlength=256 * n).reshape(n, 256).astype(float)
        counts = hist @ _MEMBERS
        share = hist / np.maximum(size, 1)[:, None]
        entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
        length = (ends - starts).astype(float)
        row_of_word = np.repeat(np.arange(n), n_words)
        mean = _spread(length, n_words) / np.maximum(n_words, 1)
        square = _spread(length * length, n_words) / np.maximum(n_words, 1)
        echo = np.zeros(len(hashes))
        if len(hashes) > 1:
            echo[1:] = (hashes[1:] == hashes[:-1]) & (row_of_word[1:] == row_of_word[:-1])
        distinct = _distinct(row_of_word, hashes, n)
        last = batch.data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        odd_end = ~(((last >= 48) & (last < 58)) | ((last >= 65) & (last < 91)) | ((last >= 97) & (last < 123)) | (last >= 128) | np.isin(last, list(b".,;:?")))
        plain = (last != ord("|")) | (length > 1)
        line_rows, line_hash = _lines(batch, lo, hi, begin, raw)
        n_lines = np.bincount(line_rows, minlength=n)
        rows.append(
            np.column_stack(
                [np.log1p(size), np.log1p(n_words), np.log1p(n_lines), np.log1p(mean), np.log1p(np.maximum(square - mean**2, 0)), entropy]
                + [_odds(counts[:, k], size) for k in range(len(_CLASSES))]
                + [
                    _odds(distinct, n_words),
                    _odds(_spread(echo, n_words), n_words),
                    _odds(_spread(odd_end, n_words), n_words),
                    _odds(_spread(~plain, n_words), n_words),
                    _odds(_distinct(line_rows, line_hash, n), n_lines),
                    np.log1p(size / np.maximum(n_lines, 1)),
                ]
            )
        )
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    if not len(row):
        return np.zeros(n, np.int64)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])))
    return np.bincount(r[new], minlength=n)


def _lines(batch: TextBatch, lo: int, hi: int, begin: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and hash of each line that is not empty."""
    edges = np.unique(np.concatenate([np.flatnonzero(raw == 10), batch.offsets[lo : hi + 1] - begin]))
    starts, ends = edges[:-1], edges[1:]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = starts + (raw[starts] == 10)
    kept = ends > starts
    starts, ends = starts[kept], ends[kept]
    row = np.searchsorted(batch.offsets[lo : hi + 1] - begin, starts, side="right") - 1
    return row, hash_spans(raw, starts, ends)


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of both classes over standardised statistics, and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [self.offsets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.slope * self.margin(x) + self.intercept)


def fit(x: np.ndarray, label: np.ndarray) -> Discriminant | None:
    """None unless both classes have at least two documents."""
    if min((label == 0).sum(), (label == 1).sum()) < 2:
        return None
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - centre) / scale
    parts = [z[label == k] for k in (0, 1)]
    own = [np.cov(p, rowvar=False) for p in parts]
    pooled = sum(c * (len(p) - 1) for c, p in zip(own, parts, strict=True)) / (len(z) - 2)
    factors, offsets = [], []
    for c, p in zip(own, parts, strict=True):
        to_pooled = max(TO_POOLED, min(1.0, x.shape[1] / len(p)))
        s = (1 - to_pooled) * c + to_pooled * pooled
        s = (1 - TO_IDENTITY) * s + TO_IDENTITY * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        root = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(root))
        offsets.append(np.log(len(p) / len(z)) - np.log(np.diag(root)).sum())
    model = Discriminant(centre, scale, np.stack([p.mean(0) for p in parts]), np.stack(factors), np.array(offsets), 1.0, 0.0)
    slope, intercept = platt(model.margin(x), label)
    return Discriminant(centre, scale, model.means, model.factors, model.offsets, slope, intercept)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, parts: int = FOLDS, held_out: int = HELD_OUT) -> Discriminant | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rows = labelled_sample(docs, labels, "quality", parts, held_out, most).mapInArrow(run, "label int, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    return fit(np.array(rows["x"].to_pylist()), rows["label"].to_numpy())


def score(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, score and predicted, row by row, beside the columns of ``docs``' text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted quality is 1."""
    model = train(docs, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at))) >= 0.5)) if model else b

    return docs.mapInArrow(run, schema)
