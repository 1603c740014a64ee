"""Reads to vertices: multiplicity, length statistics, numbering in sequence order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.params import LONGEST, SHORTEST
from strandgraph.operators.storage import stored


def multiplicity(reads: DataFrame) -> DataFrame:
    """(seq, cnt): every distinct read with how often it occurs; null reads are left out."""
    return reads.where("seq is not null").groupBy("seq").agg(F.count("*").alias("cnt"))


def length_stats(unique: DataFrame) -> DataFrame:
    """One row: distinct reads, shortest and longest length, and how many are outside the usual lengths."""
    n = F.length("seq")
    return unique.agg(
        F.count("*").alias("n_unique"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.count_if(~n.between(SHORTEST, LONGEST)).alias("n_out_of_range"),
    )


def check_lengths(reads: DataFrame, on_bad: str = "warn") -> DataFrame:
    """Reads of unusual length: kept and flagged, dropped, or an error when they are met."""
    ok = F.length("seq").between(SHORTEST, LONGEST)
    if on_bad == "drop":
        return reads.where(ok)
    if on_bad == "fail":
        return reads.withColumn("seq", F.when(ok, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("read of length "), F.length("seq").cast("string")))))
    return reads.withColumn("length_ok", ok)


def numbered(unique: DataFrame) -> DataFrame:
    """(vid, seq, cnt): vertices numbered from 0 in the order of their sequences.

    A range shuffle sorts the reads over all tasks; a prefix sum over the partitions' sizes, one row a partition,
    turns places within partitions into global numbers. No task sees all reads.
    """
    placed = unique.select("seq", "cnt").repartitionByRange("seq").sortWithinPartitions("seq")
    kept = stored(placed.select("seq", "cnt", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ordered")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    local = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(bases), "part").select((F.col("base") + local).alias("vid"), "seq", "cnt")


def merge_unique(*parts: DataFrame) -> DataFrame:
    """Distinct reads of several groups."""
    out = parts[0].select("seq")
    for part in parts[1:]:
        out = out.union(part.select("seq"))
    return out.distinct()
