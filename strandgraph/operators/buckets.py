"""Bucketing schemes: distinct (key, vid) rows in long form, never a list per key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strandgraph.functions import gapped as batches
from strandgraph.functions import kmers
from strandgraph.functions.params import Scheme


def _keyed(vertices: DataFrame, keys: Column) -> DataFrame:
    return vertices.select("vid", F.explode(keys).alias("key")).where("key is not null").select("key", "vid")


def lexicographic(vertices: DataFrame, scheme: Scheme) -> DataFrame:
    """Smallest k-mers of sliding windows, of the whole read or of each segment; keys carry no segment number."""
    return _keyed(vertices, lexicographic_keys(scheme))


def lexicographic_keys(scheme: Scheme) -> Column:
    """The keys of ``lexicographic`` of a read, as one list."""
    seq = F.col("seq")
    if scheme.segments == 1:
        return kmers.lexicographic_minimizers(seq, scheme.k, scheme.window)
    cut = F.transform(kmers.segments(seq, scheme.segments), lambda s: kmers.lexicographic_minimizers(s, scheme.k, scheme.window))
    return F.array_distinct(F.flatten(cut))


def hashed(vertices: DataFrame, scheme: Scheme, seed: int = 2024, hash_of: kmers.Hash = kmers.hash_fast) -> DataFrame:
    """Smallest k-mer hashes of sliding windows."""
    seq = F.col("seq")
    if scheme.segments == 1:
        return _keyed(vertices, kmers.hashed_minimizers(seq, scheme.k, scheme.window, seed, hash_of))
    cut = F.transform(kmers.segments(seq, scheme.segments), lambda s: kmers.hashed_minimizers(s, scheme.k, scheme.window, seed, hash_of))
    return _keyed(vertices, F.array_distinct(F.flatten(F.filter(cut, lambda x: x.isNotNull()))))


def gapped(vertices: DataFrame, seeds: list[tuple[int, int]], every: bool = False, hash_of: kmers.Hash = kmers.hash_fast) -> DataFrame:
    """One key for each (seed, k), reads too short for any sharing one; with ``every``, all gapped k-mers of the first k."""
    if every:
        return _keyed(vertices, F.array_distinct(kmers.gapped_words(F.col("seq"), seeds[0][1])))
    return _keyed(gapped_lists(vertices.select("vid", "seq"), seeds, hash_of), F.col("keys"))


def gapped_lists(vertices: DataFrame, seeds: list[tuple[int, int]], hash_of: kmers.Hash = kmers.hash_fast) -> DataFrame:
    """``vertices`` and the distinct keys of ``gapped`` of each read, as a list ``keys``."""
    by_k: dict[int, list[int]] = {}
    for seed, k in seeds:
        by_k.setdefault(k, []).append(seed)
    if hash_of is not kmers.hash_md5:
        zero = hash_of(F.lit("short")) if hash_of is kmers.hash_fast else F.lit("0")
        made = F.concat(*(kmers.gapped_min_hashes(F.col("seq"), k, own, hash_of) for k, own in by_k.items()))
        return vertices.select("*", F.array_distinct(F.transform(made, lambda h: F.coalesce(h, zero))).alias("keys"))
    names = [f"keys{k}" for k in by_k]
    schema = StructType([*vertices.schema.fields, *(StructField(name, ArrayType(StringType())) for name in names)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [batches.min_hashes(batch["seq"], k, own) for k, own in by_k.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    told = vertices.mapInArrow(run, schema)
    return told.select(*vertices.columns, F.array_distinct(F.concat(*names)).alias("keys"))


def sub_sizes(listed: DataFrame) -> DataFrame:
    """(parent, size, n) of reads with lists ``parents`` and ``keys``: reads of each bucket, and its distinct sub-buckets.

    What is counted is combined before it is shuffled, so that follows the buckets and not the reads.
    """
    none = F.array(F.lit(None).cast(listed.schema["keys"].dataType.elementType))  # a row that counts the read
    each = listed.select(F.explode("parents").alias("parent"), "keys").select("parent", F.explode(F.concat("keys", none)).alias("key"))
    told = each.groupBy("parent", "key").agg(F.count("*").alias("reads"))
    return told.groupBy("parent").agg(F.sum(F.when(F.col("key").isNull(), F.col("reads"))).alias("size"), F.count("key").alias("n"))


#: Sub-buckets that a task counts before it gives their sizes away.
COUNTED = 1 << 20


def sub_bucket_sizes(listed: DataFrame) -> DataFrame:
    """(parent, key, size) of reads with lists ``parents`` and ``keys`` of distinct strings or numbers; tasks count, and sums are shuffled."""
    element = {name: listed.schema[name].dataType.elementType for name in ("parents", "keys")}
    schema = StructType([StructField("parent", element["parents"]), StructField("key", element["keys"]), StructField("size", LongType())])
    kinds = [to_arrow_type(x) for x in element.values()]

    def given(known: list[dict[object, int]], codes: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        parents, keys = (pa.array(list(of), kind) for of, kind in zip(known, kinds, strict=True))
        for at in range(0, len(codes), 1 << 16):
            some = codes[at : at + (1 << 16)]
            columns = [parents.take(pa.array(some >> 32)), keys.take(pa.array(some & 0xFFFFFFFF)), pa.array(sizes[at : at + (1 << 16)])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[object, int]] = [{}, {}]
        codes, sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for whole in rows:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                flat, counts = [], []
                for name, of in zip(("parents", "keys"), known, strict=True):
                    told = batch[name].flatten().dictionary_encode()
                    numbers = np.array([of.setdefault(x, len(of)) for x in told.dictionary.to_pylist()], dtype=np.int64)
                    flat.append(numbers[told.indices.to_numpy()] if len(numbers) else np.zeros(0, dtype=np.int64))
                    counts.append(pc.fill_null(pc.list_value_length(batch[name]), 0).to_numpy().astype(np.int64))
                first = np.cumsum(counts[1]) - counts[1]
                made = [codes]
                for j in range(counts[1].max(initial=0)):  # the j-th key of each read beside all of its parents
                    has = counts[1] > j
                    mine = np.zeros(len(has), dtype=np.int64)
                    mine[has] = flat[1][first[has] + j]
                    made.append(((flat[0] << 32) | np.repeat(mine, counts[0]))[np.repeat(has, counts[0])])
                old = len(codes)
                codes, number = np.unique(np.concatenate(made), return_inverse=True)
                sizes = np.bincount(number, np.concatenate([sizes, np.ones(len(number) - old, dtype=np.int64)]), len(codes)).astype(np.int64)
                if len(codes) > COUNTED:
                    yield from given(known, codes, sizes)
                    known, codes, sizes = [{}, {}], codes[:0], sizes[:0]
        yield from given(known, codes, sizes)

    return listed.select("parents", "keys").mapInArrow(run, schema).groupBy("parent", "key").agg(F.sum("size").alias("size"))


def gapped_within(parents: DataFrame, vertices: DataFrame, seeds: list[tuple[int, int]], every: bool = False, hash_of: kmers.Hash = kmers.hash_fast) -> DataFrame:
    """(parent, key, vid): gapped keys inside buckets (parent, vid); a read's keys are made once, whatever buckets it is in."""
    own = vertices.hint("merge").join(parents.select("vid").distinct(), "vid", "left_semi")
    return parents.hint("merge").join(gapped(own, seeds, every, hash_of), "vid").select("parent", "key", "vid")


def sketches(vertices: DataFrame, k: int, size: int, seeds: list[int], variant: str = "prefix", hash_of: kmers.Hash = kmers.hash_fast) -> DataFrame:
    """Order-preserving sketches: of the first k-mers ("prefix"), or of those of smallest hash ("minhash"), hashed for each seed."""
    seq = F.col("seq")
    if variant not in ("prefix", "minhash"):
        raise ValueError("variant must be prefix or minhash")
    if variant == "prefix":
        made = F.array(*(kmers.prefix_sketch(seq, k, size) for _ in seeds))
    else:
        made = kmers.order_min_sketches(seq, k, size, seeds, hash_of)
    keys = kmers.bound(made, lambda m: F.array(*(hash_of(F.lit(str(s)), F.get(m, F.lit(i))) for i, s in enumerate(seeds))))
    return _keyed(vertices, F.when(F.length(seq) >= k, F.array_distinct(keys)))


def sizes(buckets: DataFrame, by: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    return buckets.groupBy(*by).agg(F.count("*").alias("size"))


def split(buckets: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of normal buckets (2 to most - 1 vertices) and of all others, a bucket of one included."""
    own = sizes(buckets)
    normal = own.where((F.col("size") >= 2) & (F.col("size") < most)).select("key")
    large = own.where((F.col("size") < 2) | (F.col("size") >= most)).select("key")
    return buckets.hint("merge").join(normal, "key", "left_semi"), buckets.hint("merge").join(large, "key", "left_semi")


def union_keys(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()
