"""Edge tables: histogram, weight filter, insert-if-absent, and bounded traversal.

Joins of tables that grow with the reads are hinted, so that none of them is broadcast through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.components import components
from strandgraph.operators.pairs import exact
from strandgraph.operators.storage import stored


def summary(edges: DataFrame) -> DataFrame:
    """Edges by weight, and their total in the row whose weight is null."""
    return edges.rollup("weight").agg(F.count("*").alias("n"))


def without_weights(edges: DataFrame, low: int, high: int) -> DataFrame:
    return edges.where(~F.col("weight").between(low, high))


def inserted(edges: DataFrame, more: DataFrame) -> DataFrame:
    """``edges`` and those of ``more`` that are not among them; the first weight of a pair stays."""
    new = more.dropDuplicates(["src", "dst"]).hint("merge").join(edges, ["src", "dst"], "left_anti")
    return edges.select("src", "dst", "weight").unionByName(new.select("src", "dst", "weight"))


def within_hops(edges: DataFrame, sources: DataFrame | None, depth: int) -> DataFrame:
    """(src, dst): vertices that at most ``depth`` edges lead to, from each source, the source itself left out.

    Breadth first: each round joins the newest rows with the edges and keeps what is new; rounds are stored, and the
    last is the first that finds nothing.
    """
    near = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "near")
    start = near if sources is None else near.hint("merge").join(sources.select(F.col("vid").alias("src")), "src", "left_semi")
    seen = frontier = stored(start, "hops")
    step = near.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for _ in range(depth - 1):
        reach = frontier.hint("merge").join(step, "dst").select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
        frontier = stored(reach.hint("merge").join(seen, ["src", "dst"], "left_anti"), "hops")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.union(frontier)
    return seen


#: Neighbours of a vertex that are walked to in one task; a vertex with more is dealt into blocks.
BLOCK = 1000


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, part, next) for both directions of the edges, and (node, parts) of the nodes of more than one part."""
    near = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("node", "next"), "near")
    heavy = stored(near.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"), "heavy")
    part = F.coalesce(F.pmod(F.xxhash64("next"), F.col("parts")).cast("int"), F.lit(0))
    return near.hint("merge").join(heavy, "node", "left").select("node", part.alias("part"), "next"), heavy


def walked(walkers: DataFrame, near: DataFrame, heavy: DataFrame) -> DataFrame:
    """(start, node) one edge further: walkers at a heavy node go to each of its parts, so its neighbours spread over tasks."""
    spread = walkers.hint("merge").join(heavy, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return spread.hint("merge").join(near, ["node", "part"]).select("start", F.col("next").alias("node")).distinct()


def connected(pairs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Those of the pairs (src, dst) that a walk of at most ``depth`` edges leads between.

    Pairs of different components are dropped before any walk. Only the others are asked for: walks start at both of their
    ends by turns, so each side goes half as far, and a pair that has met leaves the search. No other pair of a
    component is ever made.
    """
    comps = components(edges)
    ends = [comps.select(F.col("vid").alias(end), F.col("comp").alias(f"{end}_comp")) for end in ("src", "dst")]
    asked = pairs.select("src", "dst").where("src <> dst").distinct()
    open_pairs = stored(asked.hint("merge").join(ends[0], "src").hint("merge").join(ends[1], "dst").where("src_comp = dst_comp").select("src", "dst"), "open")
    near, heavy = adjacency(edges)
    met: list[DataFrame] = []
    reached = {end: open_pairs.select(F.col(end).alias("start"), F.col(end).alias("node")).distinct() for end in ("src", "dst")}
    fresh = dict(reached)
    for step in range(depth):
        if open_pairs.limit(1).count() == 0:
            break
        side = ("src", "dst")[step % 2]
        wanted = open_pairs.select(F.col(side).alias("start")).distinct()
        moved = walked(fresh[side].hint("merge").join(wanted, "start", "left_semi"), near, heavy)
        fresh[side] = stored(moved.hint("merge").join(reached[side], ["start", "node"], "left_anti"), "fresh")
        if fresh[side].limit(1).count() == 0:  # these ends have seen all that they can reach
            break
        reached[side] = reached[side].union(fresh[side])
        other = ("dst", "src")[step % 2]
        here = fresh[side].withColumnRenamed("start", side)
        there = reached[other].withColumnRenamed("start", other)
        now = stored(open_pairs.hint("merge").join(here, side).hint("merge").join(there, [other, "node"]).select("src", "dst").distinct(), "met")
        met.append(now)
        open_pairs = stored(open_pairs.hint("merge").join(now, ["src", "dst"], "left_anti"), "open")
    return reduce(DataFrame.union, met) if met else pairs.select("src", "dst").limit(0)


def verified_hops(edges: DataFrame, vertices: DataFrame, sources: DataFrame | None, depth: int, least: int, most: int) -> DataFrame:
    """Edges within the range between vertices that the traversal connects and no edge does yet.

    Only what is within the range and no edge yet can be added, so only that is asked of the graph; no pair is made
    because a walk leads there. ``vertices`` are read more than once: store them.
    """
    missing = stored(exact(vertices, least, most).hint("merge").join(edges, ["src", "dst"], "left_anti"), "missing")
    asked = missing
    if sources is not None:
        asked = reduce(DataFrame.union, (missing.hint("merge").join(sources.select(F.col("vid").alias(end)), end, "left_semi").select("src", "dst", "weight") for end in ("src", "dst")))
    return missing.hint("merge").join(connected(asked, edges, depth), ["src", "dst"], "left_semi").select("src", "dst", "weight")
