"""Exact top-k by inner product through a pivot-distance index.

Every vector is keyed by its length, its nearest pivot and the ring of its distance to it; such a key is an annulus.
For a query at distance d from a pivot, a vector in an annulus with distances [lo, hi] is at least max(0, d - hi, lo - d)
away, by the triangle inequality; with the largest norm of the annulus that bounds its inner product with the query from above.

Each query first opens the annuli of the highest bounds that together hold enough vectors, which gives it a threshold: its
k-th best score so far. It then opens only annuli that could still reach the threshold. Inside one, vectors lie in the
order of their distances, and only those between the two distances that the threshold allows are scored. Annuli are cut
into blocks, so that an annulus of any size spreads over tasks, and queries that lie side by side travel in tiles: a tile meets a block
once, with those of its queries that open the annulus. All arithmetic that decides a score is on integers.

How much the bounds skip depends on the data: nearly all where vectors lie in clusters, nothing where they point in
random directions of many dimensions, whose distances all are alike. Results are exact either way.

Edge cases: null vectors and vectors with null or non-finite components take no part, nor do null ids; vectors of
each length are searched among their own, in the same jobs whatever the number of lengths, empty ones too, whose scores all are 0; components so large that scores would
pass 64 bits are an error; fewer candidates than k give all; ties go to the smaller id; an id that
repeats is a candidate each time, but never its own query's; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.shared import binary_array, materialise

#: Pivots for few and for many vectors, rings of each, and the rows among which pivots are chosen; none changes a result.
PIVOTS, PIVOTS_MOST, RINGS, SAMPLE = 32, 256, 8, 4096
#: Vectors in a block of an annulus, and their components, whichever are fewer.
BLOCK, BLOCK_COMPONENTS = 1 << 15, 1 << 21
#: Queries in a tile, their components, and how many of a tile's queries are scored together.
TILE, TILE_COMPONENTS, TOGETHER = 128, 1 << 13, 64
#: A length that no vector of the sample has is held by at most one vector of so many, but for a chance of 1e-7.
RARE = SAMPLE // 16
NO_LIMIT = -(1 << 62)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components turned into floor(scale * x); rows with anything else than finite numbers are left out."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    norm = F.aggregate("embedding", F.lit(0.0), lambda sums, e: sums + F.pow(F.floor(e.cast("double") * scale).cast("double"), 2))
    large = F.raise_error(F.lit("an embedding's integers are too large for scores of 64 bits"))
    return kept.select(F.col("vec_id").cast("long"), F.when(norm < float(1 << 63), x).otherwise(large.cast("array<bigint>")).alias("v"))


def pivot_count(n: int) -> int:
    """More pivots for more vectors, so that annuli stay few beside them."""
    return int(np.clip(np.sqrt(n) / 8, PIVOTS, PIVOTS_MOST))


def blocks_of(n: np.ndarray | int, width: int) -> np.ndarray:
    """Into how many blocks annuli of n vectors are cut."""
    return np.maximum(1, -(-np.asarray(n) // max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, width)))))


def farthest_pivots(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n pivots, by repeatedly taking the point of a bounded sample that is farthest from those taken, and the bounds
    of each one's rings, by the quantiles of its own share of the sample."""
    taken = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    far = ((x - x[taken[0]]) ** 2).sum(1)
    while len(taken) < min(n, len(x)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[taken[-1]]) ** 2).sum(1))
    pivots = x[taken]
    d = distances(x, pivots)
    own, near = d.argmin(1), d.min(1)
    share = np.arange(1, RINGS) / RINGS
    return pivots, np.array([np.quantile(near[own == p], share) if (own == p).any() else np.quantile(near, share) for p in range(len(pivots))])


Pivots = dict[int, tuple[np.ndarray, np.ndarray]]


def choose_pivots(vectors: DataFrame, n: int) -> Pivots:
    """Pivots and bounds of rings for each length that a sample of SAMPLE vectors has; n is the number of all vectors.

    Lengths that the sample misses go without pivots. So the driver holds as little for thousands of lengths as for one.
    """
    drawn: dict[int, list[list[int]]] = {}
    for v in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["v"].to_pylist():
        drawn.setdefault(len(v), []).append(v)
    size = sum(map(len, drawn.values()))
    return {width: farthest_pivots(np.array(rows, float), pivot_count(n * len(rows) // size)) for width, rows in sorted(drawn.items())}


def _by_width(widths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for width in np.unique(widths).tolist():
        yield width, np.flatnonzero(widths == width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)))


def index(vectors: DataFrame, pivots: Pivots, n: int) -> DataFrame:
    """(vec_id, width, pivot, ring, distance, norm, blocks, v) of every vector; ring counts its pivot's bounds below the distance.

    Vectors of a length without pivots lie in one annulus, pivot -1, whose blocks follow from the number n of all vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, at in _by_width(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)):
                part = b.take(pa.array(at))
                x = _matrix(part.column(1), width)
                own, ring, near, blocks = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)), None
                if width in pivots:
                    points, edges = pivots[width]
                    d = distances(x.astype(float), points)
                    own = d.argmin(1)
                    near = d[np.arange(len(x)), own]
                    ring = (edges[own] < near[:, None]).sum(1)
                else:
                    blocks = int(blocks_of(n // RARE, width))
                whole = [pa.array(c.astype(np.int32)) for c in (np.full(len(x), width), own, ring)]
                cols = [part.column(0), *whole, pa.array(near), pa.array((x.astype(float) ** 2).sum(1)), pa.array([blocks] * len(x), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, binary_array([r.tobytes() for r in x.astype("<i8")])], ["vec_id", "width", "pivot", "ring", "distance", "norm", "blocks", "v"])

    return vectors.mapInArrow(run, "vec_id long, width int, pivot int, ring int, distance double, norm double, blocks int, v binary")


class Block:
    """Vectors of an annulus in the order of their distance to the pivot."""

    def __init__(self, ids: list[int], distance: list[float], norm: list[float], rows: list[bytes], width: int) -> None:
        self.ids, self.distance, self.norm = np.array(ids, np.int64), np.array(distance), max(norm, default=0.0)
        self.x = np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width).astype(float)
        self.largest = np.abs(self.x).max(initial=0)

    def best(self, names: np.ndarray, least: np.ndarray, apart: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """Each query's k best that reach its threshold, and how many vectors were scored.

        A score of at least t puts a vector within sqrt(|q|^2 + norm - 2 t) of the query, and its distance to the pivot
        within that of the query's.
        """
        reach = np.sqrt(np.maximum(0, (q**2).sum(1) + self.norm - 2 * least.astype(float)))
        slack = 1e-6 * (1 + apart + reach)
        lo, hi = np.searchsorted(self.distance, apart - reach - slack), np.searchsorted(self.distance, apart + reach + slack, side="right")
        a, b = int(lo.min()), int(hi.max())
        x, ids = self.x[a:b], self.ids[a:b]
        whole = np.abs(q).max(initial=0) * self.largest * q.shape[1] < 2**52
        scores = np.rint(q @ x.T).astype(np.int64) if whole else q.astype(np.int64) @ x.astype(np.int64).T
        out = []
        for name, limit, s in zip(names.tolist(), least.tolist(), scores, strict=True):
            at = np.flatnonzero((s >= limit) & (ids != name))
            if len(at) > k:
                floor = np.partition(s[at], len(at) - k)[len(at) - k]
                at = at[s[at] >= floor]
                at = at[np.lexsort((ids[at], -s[at]))[:k]]
            out.append((np.full(len(at), name), ids[at], s[at]))
        return out, (b - a) * len(q)


HEAD = ("width", "pivot", "ring", "block")


def _score(members: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query in each block, its k best that reach the query's threshold.

    Rows stream through sorted partitions, a block's members before its tiles; a task holds one block.
    """
    none = F.lit(None).cast("binary")
    empty = {"vec_id": F.lit(0).cast("long"), "distance": F.lit(0.0), "norm": F.lit(0.0), "names": none, "least": none, "apart": none}
    fields = [*HEAD, "side", *empty, "v"]
    held, asked = (df.withColumns({"side": F.lit(side)} | {c: e for c, e in empty.items() if c not in df.columns}) for side, df in ((0, members), (1, tiles)))
    ordered = held.select(*fields).unionByName(asked.select(*fields)).repartition(*HEAD).sortWithinPartitions(*HEAD, "side", "distance")

    def found(block: Block, width: int, names: bytes, least: bytes, apart: bytes, v: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        name, limit, away = np.frombuffer(names, "<i8"), np.frombuffer(least, "<i8"), np.frombuffer(apart, "<f8")
        q = np.frombuffer(v, "<i8").reshape(len(name), width).astype(float)
        return [o for i in range(0, len(name), TOGETHER) for o in block.best(*(c[i : i + TOGETHER] for c in (name, limit, away, q)), k)[0]]

    def emit(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, block = None, [], None
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for *key, side, vec_id, distance, norm, names, least, apart, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != cell:
                    cell, rows, block = key, [], None
                if side == 0:
                    rows.append((vec_id, distance, norm, v))
                elif rows or block:
                    if rows:
                        block, rows = Block(*(list(c) for c in zip(*rows, strict=True)), key[0]), []
                    out += found(block, key[0], names, least, apart, v)
                    if len(out) >= 8192:
                        yield emit(out)
                        out = []
            yield emit(out)

    return ordered.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. k rows at most come from each block, so no group grows with the number of vectors scored."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Annuli:
    """What bounds a query's scores in each annulus of one length. Annuli of all lengths together are at most SAMPLE * RINGS,
    and PIVOTS_MOST * RINGS where there is one length, whatever the number of vectors."""

    def __init__(self, pivots: np.ndarray, stats: pd.DataFrame) -> None:
        self.pivot, self.ring, self.n, self.lo, self.hi, self.norm, self.blocks = (stats[c].to_numpy() for c in ("pivot", "ring", "n", "lo", "hi", "norm", "blocks"))
        self.pivots = pivots

    def visits(self, x: np.ndarray, least: np.ndarray, first: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, annulus, distance to its pivot) of the annuli that queries open: at first those of the highest bounds,
        then all others that could reach the query's threshold."""
        d = distances(x, self.pivots)[:, self.pivot]
        square = (x**2).sum(1)[:, None]
        # beyond what rounding can do to distances and norms
        apart = np.maximum(0, np.maximum(d - self.hi, self.lo - d) - 1e-6 * (1 + d) - 1e-7 * np.sqrt(square + self.norm))
        bound = (square + self.norm - apart**2) / 2 + 1e-6 * (1 + self.norm) + 1e-9 * square
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        seeded = np.zeros(bound.shape, bool)
        np.put_along_axis(seeded, order, before <= 4 * k, axis=1)
        q, c = np.nonzero(seeded if first else ~seeded & (bound >= least[:, None]))
        return q, c, d[q, c]


def _tiles(queries: DataFrame, annuli: dict[int, Annuli], n: int, first: bool, k: int) -> DataFrame:
    """(width, pivot, ring, block, names, least, apart, v): for each tile of queries and each block, the queries of the tile that
    open the block's annulus, by their distance to its pivot."""

    def tile(width: int, names: np.ndarray, least: np.ndarray, rows: list[bytes]) -> Iterator[tuple]:
        whole = np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)
        if width in annuli:
            a = annuli[width]
            q, c, d = a.visits(whole.astype(float), least, first, k)
            order = np.lexsort((d, c))
            q, c, d = q[order], c[order], d[order]
            for at in np.split(np.arange(len(c)), np.flatnonzero(np.diff(c)) + 1):
                if len(at):
                    cell, own = c[at[0]], q[at]
                    yield width, a.pivot[cell], a.ring[cell], a.blocks[cell], names[own].tobytes(), least[own].tobytes(), d[at].tobytes(), whole[own].tobytes()
        elif first:  # a length without pivots is scored whole at once
            yield width, -1, 0, blocks_of(n // RARE, width), names.tobytes(), least.tobytes(), np.zeros(len(rows)).tobytes(), whole.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int32()] * 4, *[pa.binary()] * 4]
        for b in batches:
            names, least, widths = (b.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(3))
            vectors = b.column(3).to_pylist()
            for width, at in _by_width(widths):
                step = int(np.clip(TILE_COMPONENTS // width, 1, TILE))
                for some in np.split(at, range(step, len(at), step)):
                    made = tile(width, names[some], least[some], [vectors[i] for i in some])
                    while rows := list(islice(made, 64)):
                        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(cols, ["width", "pivot", "ring", "blocks", "names", "least", "apart", "v"])

    # neighbours share tiles, so that a tile opens few annuli beyond those of each of its queries
    beside = queries.repartitionByRange("width", "pivot", "distance", "vec_id").sortWithinPartitions("width", "pivot", "distance", "vec_id")
    made = beside.select("vec_id", "least", "width", "v").mapInArrow(run, "width int, pivot int, ring int, blocks int, names binary, least binary, apart binary, v binary")
    return made.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the exact k best of every query among all other rows."""
    every = integers(vectors)
    empty, whole = every.where(F.size("v") == 0), every.where(F.size("v") > 0)
    none = _empty_top_k(empty, is_query, k)
    n = whole.count()
    if not n:
        return none
    pivots = choose_pivots(whole, n)
    placed = materialise(index(whole, pivots, n), "index")
    by = ["width", "pivot", "ring"]
    stats = placed.where("pivot >= 0").groupBy(*by).agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max("norm").alias("norm"))
    told = stats.orderBy(*by).toPandas()
    told["blocks"] = [int(blocks_of(count, width)) for count, width in zip(told["n"], told["width"], strict=True)]
    annuli = {int(width): Annuli(pivots[int(width)][0], part) for width, part in told.groupby("width")}
    rows = [tuple(map(int, r)) for r in told[[*by, "blocks"]].itertuples(index=False)]
    sizes = whole.sparkSession.createDataFrame(rows, "width int, pivot int, ring int, cut int")
    blocks = F.coalesce("cut", "blocks")
    members = placed.join(F.broadcast(sizes), by, "left").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int"))

    def scored(queries: DataFrame, first: bool) -> DataFrame:
        return _score(members, _tiles(queries, annuli, n, first, k), k)

    queries = placed.where(is_query).select("vec_id", "width", "pivot", "distance", "v", F.lit(NO_LIMIT).cast("long").alias("least"))
    seeds = materialise(_best(scored(queries, True), k), "seeds")
    limits = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    limited = queries.join(limits, "vec_id", "left").withColumn("least", F.coalesce("reached", "least"))
    best = _best(seeds.select("query_id", "vec_id", "score").unionByName(scored(limited, False)), k)
    return best.select("query_id", "rank", "vec_id", "score").unionByName(none)


def _empty_top_k(empty: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The same for vectors without components: all score 0, so the k smallest other ids are the best of each query.

    Whatever query is left out, these are among the k + 1 smallest ids, each at most k times: so many rows reach the driver.
    """
    few = empty.groupBy("vec_id").agg(F.count("*").alias("n")).orderBy("vec_id").limit(k + 1).collect()
    least = F.array(*(F.lit(r["vec_id"]).cast("long") for r in few for _ in range(min(r["n"], k)))).cast("array<bigint>")
    others = F.slice(F.filter(least, lambda x: x != F.col("vec_id")), 1, k)
    found = empty.where(is_query).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "vec_id"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
