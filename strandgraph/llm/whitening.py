"""Whitening of embeddings, with a covariance by polarisation.

The covariance of two dimensions is half of what the variance of their sum exceeds the sum of their variances by. So a
pass over the vectors adds up squares of centred whole numbers alone, one sum for each dimension and each pair of
dimensions; all are exact. The matrix is put together from these sums and goes to ``eigh``.

A component c becomes the whole number x = floor(1024 * c) + 100000. Centring is exact: with S the sum of a dimension over n vectors,
n * x - S is a whole number. It is held as n * y - r, y = x less the whole part of the mean and r what the mean has left,
so that tasks square small numbers and the large factors meet the finished sums, in Python's integers.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped. Vectors of each length are whitened
among their own; empty ones have no component and give no row. A component without variance (one vector, equal vectors,
fewer vectors than dimensions) has whitened 0.0 and is left out of the identity; explained is 0.0 where nothing varies.
Ids may be null or repeat, each row is its own. Components beyond 2^51 / 1024 raise ValueError in the task, as
they would not fit whole numbers of 64 bits. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.shared import materialise

SCALE, SHIFT = 1024, 100_000
#: Components that are given.
COMPONENTS = 8
#: Vectors that are squared at a time.
ROWS = 1000
#: Largest absolute value of SCALE * c.
LARGEST = float(1 << 51)
EXACT = "decimal(38,0)"


def _whole(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the vectors of each length in a batch whose column 1 has lists of doubles; at most ROWS at a time."""
    column = b.column(1)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row, weights=~np.isfinite(flat), minlength=len(size)) > 0
    first = np.cumsum(size) - size
    for length in np.unique(size[~bad & (size > 0)]).tolist():
        own = np.flatnonzero((size == length) & ~bad)
        for at in range(0, len(own), ROWS):
            rows = own[at : at + ROWS]
            scaled = flat[first[rows][:, None] + np.arange(length)] * SCALE
            if np.abs(scaled).max() > LARGEST:
                raise ValueError("an embedding has a component that does not fit 64-bit whole numbers")
            yield rows, np.floor(scaled).astype(np.int64) + SHIFT


def _vectors(table: DataFrame) -> DataFrame:
    return table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _exact_array(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


@dataclass(frozen=True)
class Centre:
    """How many vectors of a length there are, and the sum of each dimension; ``whole`` and ``rest`` are the mean's."""

    n: int
    total: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.total], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.total]


def centres(table: DataFrame) -> dict[int, Centre]:
    """By length: the number of vectors and the exact sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for rows, x in _whole(b):
                n, s = held.get(x.shape[1], (0, 0))
                held[x.shape[1]] = n + len(rows), s + x.sum(0).astype(object)
        for size, (n, s) in held.items():
            cols = [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), _exact_array(s.tolist())]
            yield pa.RecordBatch.from_arrays(cols, ["size", "dim", "n", "s"])

    parts = _vectors(table).mapInArrow(run, f"size int, dim int, n long, s {EXACT}")
    found: dict[int, list] = {}
    # one row for each dimension
    for r in parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast(EXACT).alias("s")).orderBy("size", "dim").toArrow().to_pylist():
        found.setdefault(r["size"], []).append((r["n"], int(r["s"])))
    return {size: Centre(rows[0][0], [s for _, s in rows]) for size, rows in found.items()}


def pair_squares(table: DataFrame, known: dict[int, Centre]) -> DataFrame:
    """(size, i, j, total): exact sums over all vectors of y_i^2 (where i = j) and (y_i + y_j)^2, y being x less the
    whole part of its mean."""
    whole = {size: c.whole for size, c in known.items()}

    def told(size: int, sums: np.ndarray) -> pa.RecordBatch:
        i, j = np.triu_indices(size)
        values = sums[i, j].tolist()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _exact_array(values)], ["size", "i", "j", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        bound: dict[int, int] = {}
        for b in batches:
            for rows, x in _whole(b):
                size = x.shape[1]
                y = x - whole[size]
                most = len(rows) * (2 * int(np.abs(y).max())) ** 2
                if bound.get(size, 0) + most >= 1 << 62 and size in held:
                    yield told(size, held.pop(size))
                    bound[size] = 0
                if most >= 1 << 62:  # squares beyond 64 bits are added as Python's integers
                    y = y.astype(object)
                sums = np.zeros((size, size), y.dtype)
                for i in range(size):
                    both = y[:, i:] + y[:, i : i + 1]
                    both[:, 0] = y[:, i]
                    sums[i, i:] = (both * both).sum(0)
                if y.dtype == object:
                    yield told(size, sums)
                    continue
                held[size] = held[size] + sums if size in held else sums
                bound[size] = bound.get(size, 0) + most
        for size, sums in held.items():
            yield told(size, sums)

    parts = _vectors(table).mapInArrow(run, f"size int, i int, j int, total {EXACT}")
    return parts.groupBy("size", "i", "j").agg(F.sum("total").cast(EXACT).alias("total"))


def covariance(centre: Centre, squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance of x, divisor n, each entry rounded once from its exact value.

    n^2 * squares - n * rest^2 is the sum of (n * x - S)^2; cross terms are half of what the pair's sum exceeds both by.
    """
    n, rest, size = centre.n, centre.rest, len(centre.total)
    own = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(size)]
    v = np.zeros((size, size))
    for i in range(size):
        v[i, i] = own[i] / n**3
        for j in range(i + 1, size):
            pair = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (pair - own[i] - own[j]) / (2 * n**3)
    return v


@dataclass(frozen=True)
class Whitener:
    """Of the vectors of one length: their centre, eigenvalues by size, and projection (dimension, component) over the
    root of the eigenvalue; zero where nothing varies."""

    centre: Centre
    values: np.ndarray
    project: np.ndarray
    explained: list[float]

    @property
    def live(self) -> list[int]:
        return [k for k in range(self.project.shape[1]) if self.project[:, k].any()]


def whitener(centre: Centre, v: np.ndarray, components: int = COMPONENTS) -> Whitener:
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > len(v) * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    top = min(components, len(v))
    project = np.zeros((len(v), top))
    for k in range(top):
        if values[k] > 0:
            project[:, k] = vectors[:, k] / np.sqrt(values[k])
    trace = float(np.trace(v))
    return Whitener(centre, values, project, [float(values[k] / trace) if trace else 0.0 for k in range(top)])


def fit(table: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each length of vectors; the driver holds one row for each pair of dimensions."""
    known = centres(table)
    squares: dict[int, dict[tuple[int, int], int]] = {size: {} for size in known}
    if known:
        for r in pair_squares(table, known).toArrow().to_pylist():
            squares[r["size"]][r["i"], r["j"]] = int(r["total"])
    return {size: whitener(c, covariance(c, squares[size]), components) for size, c in known.items()}


def transform(table: DataFrame, models: dict[int, Whitener]) -> DataFrame:
    """(vec_id, size, n, deviation, whitened) of every vector that is not dropped; deviation is exact, a decimal."""
    told = {size: (m.centre.n, m.centre.whole, np.array(m.centre.rest, object), m.project) for size, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _whole(b):
                n, whole, rest, project = told[x.shape[1]]
                y = x - whole
                small = (n * (int(np.abs(y).max()) + 1)) ** 2 * x.shape[1] < 1 << 62
                far = n * y - rest.astype(np.int64) if small else n * y.astype(object) - rest
                white = (far.astype(float) / n) @ project
                cols = [b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(np.full(len(rows), n, np.int64)), _exact_array((far * far).sum(1).tolist())]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * project.shape[1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([*cols, values], ["vec_id", "size", "n", "deviation", "whitened"])

    vectors = _vectors(table)
    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, size int, n long, deviation {EXACT}, whitened array<double>")


def identity_errors(whitened: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """By length: the largest absolute entry of the whitened vectors' covariance minus the identity, measured on them."""
    top = max(m.project.shape[1] for m in models.values())
    w = [F.get("whitened", F.lit(k)) for k in range(top)]
    sums = [F.avg(w[i]).alias(f"m{i}") for i in range(top)] + [F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i in range(top) for j in range(i, top)]
    out = {}
    for r in whitened.groupBy("size").agg(*sums).toArrow().to_pylist():
        live = models[r["size"]].live
        off = [abs(r[f"p{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i in live for j in live if i <= j]
        out[r["size"]] = max(off, default=0.0)
    return out


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    models = fit(table, components)
    rows = transform(table, models)
    spark = table.sparkSession
    errors = {}
    if models:
        rows = materialise(rows, "whitened")
        errors = identity_errors(rows, models)
    # one row for each length of vectors
    facts = spark.createDataFrame([(size, m.explained, errors[size]) for size, m in models.items()], "size int, explained array<double>, identity_error double")
    each = rows.join(F.broadcast(facts), "size").select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "w"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), "identity_error")
