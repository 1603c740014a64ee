"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every document once, in its partition, and stores the ids with a running total inside the
partition. The partitions' totals, a table as long as there are partitions, give each partition its global offset by
a prefix sum. Pass two knows every document's global position and cuts it at the window boundaries, with no
shuffle of tokens. Only the last sequence of a corpus can be short.

Edge cases: null or empty text is a document of the end id alone; null, repeated or tied ids are packed row by row as
they are; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm import tokens
from strandgraph.llm.shared import binary_array, materialise

TOKENISED = "doc_id long, pid int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, its partition, the tokens before it there, its count with the end id, and its ids as uint16 bytes."""
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, pid, before = tokens.memo(path), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(2, "little")
        for batch in batches:
            ids = [memo.ids(text) + end for text in batch.column(1).to_pylist()]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), pid, np.int32)), pa.array(first), pa.array(n), binary_array(ids)],
                ["doc_id", "pid", "before", "n", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENISED)


def global_offsets(tokenised: DataFrame) -> DataFrame:
    """pid -> tokens in all earlier partitions. One row a partition, whatever the number of documents."""
    totals = tokenised.groupBy("pid").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("pid", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def cut(placed: DataFrame, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of documents at known global positions, one for each window that a document touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            first, last = at // size, (at + n - 1) // size
            rows = np.repeat(np.arange(len(at)), last - first + 1)
            step = np.arange(len(rows)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            window = first[rows] + step
            lo, hi = np.maximum(at[rows], window * size), np.minimum(at[rows] + n[rows], (window + 1) * size)
            start, ids = lo - at[rows], batch.column(3)
            sums, blobs = np.empty(len(rows), np.int64), []
            held, wide = -1, b""
            for k, row in enumerate(rows):
                if row != held:
                    held, wide = row, np.frombuffer(ids[int(row)].as_buffer(), "<u2").astype("<u4").tobytes()
                piece = memoryview(wide)[4 * int(start[k]) : 4 * int(start[k] + hi[k] - lo[k])]
                sums[k] = zlib.crc32(piece)
                if with_ids:
                    blobs.append(bytes(piece))
            out = [batch.column(0).take(pa.array(rows)), *map(pa.array, (start, hi - lo, sums, n[rows], window, lo - window * size))]
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(out + [binary_array(blobs)] * with_ids, names + ["ids"] * with_ids)

    columns: list[Column | str] = ["doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids"]
    return placed.select(*columns).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, size: int = 4096, vocabulary: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``with_ids`` also its ids as little-endian uint32."""
    stored = materialise(tokenise(docs, vocabulary, end_id), "tokens")
    # one row of two numbers for each partition of the tokenising job: the number of partitions bounds its size
    return cut(stored.join(F.broadcast(global_offsets(stored)), "pid"), size, with_ids)


def sequences(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Whole sequences from pieces with ids: the ids in order, the real length and the padded length.

    A sequence is padded to ``size`` unless its length is a power of two. A sequence holds at most ``size`` ids, so no
    group here grows with the corpus.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    n = F.col("n_tokens")
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
        .select(
            "sequence_id",
            "n_tokens",
            F.when(F.bit_count(n) == 1, n).otherwise(F.lit(size).cast("long")).alias("padded"),
            F.expr("aggregate(transform(parts, p -> p.ids), X'', (a, b) -> concat(a, b))").alias("ids"),
            F.expr("transform(parts, p -> struct(p.doc_id, p.offset, p.length))").alias("documents"),
        )
    )
