"""Connected components of an edge table, by joins and minima only.

Two contractions take turns. The first hangs every larger neighbour of a vertex on the smallest vertex that it sees; the second does so
with its smaller neighbours and itself. Edges never grow in number, and what is left in the end are stars whose centres
are the smallest vertices. Minima are combined before the shuffle, and a vertex's edges are joined, not gathered, so a
hub costs no long task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.storage import dropped, stored


def _outward(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each vertex go to the smallest vertex around it; rows (u, v) with u > v."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _inward(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and the vertex itself, go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.hint("merge").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(vid, comp): the smallest vertex of each vertex's component; of those with an edge, and of ``vertices`` (vid) if given."""
    now = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "stars")
    told = None
    while True:
        # the same rows as before: count and an order-free sum of hashes
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == told:
            break
        told, before = mark, now
        out = stored(_outward(before), "stars")
        now = stored(_inward(out), "stars")
        dropped(before, out)
    stars = now.select(F.col("u").alias("vid"), F.col("v").alias("comp"))
    placed = stars.union(now.select(F.col("v").alias("vid"), F.col("v").alias("comp")).distinct())
    if vertices is None:
        return placed
    return vertices.select("vid").hint("merge").join(placed, "vid", "left").select("vid", F.coalesce("comp", "vid").alias("comp"))
