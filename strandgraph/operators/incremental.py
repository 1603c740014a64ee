"""A graph that grows: reads come in batches, and each batch looks only for its own edges.

Letters and hashes of all reads so far are kept in tables that are written in buckets, by sequence, by number and by hash, so
that a join with them deals out the new rows only. A vertex keeps its number; a read that comes again adds to its
count. A batch is part of the graph once its line in ``commits`` is written; what a batch that was lost before then has left is not read.

Of a read only its own segments are kept, with its letters; new reads ask for those of shorter, equal and longer ones, and pairs are
verified where they meet. Reads are cut into as many segments as their number asks for; where it has outgrown those of
some length, its reads are cut anew, once for about every 64 times as many.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.operators import pairs, reads
from strandgraph.operators.storage import stored

#: Roles of a hash: of what deletions leave; of a read's own segments it is the number of segments.
LEFT = 0
TABLES = {"by_seq": ("vid bigint, seq string, batch string", "seq"), "by_vid": ("vid bigint, seq string, batch string", "vid"), "hashes": ("h bigint, role int, vid bigint, seq string, batch string", "h")}
PLAIN = {
    "counts": "vid bigint, cnt bigint, batch string",
    "edges": "src bigint, dst bigint, weight int, batch string",
    "sizes": "size int, n bigint, parts int, batch string",
    "commits": "batch string, first bigint, n bigint",
}


class GrowingGraph:
    """Vertices and edges within ``most`` edits in a folder that all executors share; the same folder goes on with its graph.

    ``buckets`` is the number of files groups of each table, fixed when a folder is begun: about the reads expected
    in the end over some ten million.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 2, buckets: int = 16, often: int = pairs.OFTEN) -> None:
        self.spark, self.folder, self.most, self.buckets, self.often = spark, folder.rstrip("/"), most, buckets, often
        self.name = "growing_" + uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex
        for table, (columns, by) in TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.folder}/{table}'")
        for table, columns in PLAIN.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}) USING parquet LOCATION '{self.folder}/{table}'")

    def _append(self, table: str, rows: DataFrame) -> None:
        by = TABLES[table][1] if table in TABLES else None
        if by:  # one file for each bucket, not one for each bucket and task
            rows = rows.repartition(self.buckets, by)
        rows.write.insertInto(f"{self.name}_{table}")

    def _all(self, table: str) -> DataFrame:
        self.spark.catalog.refreshTable(f"{self.name}_{table}")
        return self.spark.table(f"{self.name}_{table}")

    def _done(self, table: str, also: str | None = None) -> DataFrame:
        """Rows of the batches that are committed, and of the one at work."""
        batches = [r["batch"] for r in self._all("commits").select("batch").collect()] + [also] * (also is not None)
        return self._all(table).where(F.col("batch").isin(batches))

    def add(self, batch_of_reads: DataFrame) -> DataFrame:
        """Take in a table with a ``seq`` column; returns the edges (src, dst, weight) that it brings."""
        batch = uuid.uuid4().hex
        unique = stored(reads.multiplicity(batch_of_reads), "unique")
        known = self._done("by_seq").select("vid", "seq")
        first = self._all("commits").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        again = unique.join(known, "seq").select("vid", "cnt")
        new = reads.numbered(unique.join(known, "seq", "left_anti")).select((F.col("vid") + first).alias("vid"), "seq", "cnt")
        new = stored(new, "new")
        rows = new.select("vid", "seq", F.lit(batch).alias("batch"))
        self._append("by_seq", rows)
        self._append("by_vid", rows)
        parts, before = self._cuts(new)
        self._append("sizes", self.spark.createDataFrame([(size, n, p, batch) for size, (n, p) in parts.items()], PLAIN["sizes"]))
        found = self._edges(new, {size: p for size, (_, p) in parts.items()}, before, first, batch)
        self._append("edges", found.select("*", F.lit(batch).alias("batch")))
        self._append("counts", again.union(new.select("vid", "cnt")).select("*", F.lit(batch).alias("batch")))
        self._append("commits", self.spark.createDataFrame([(batch, first, new.count())], PLAIN["commits"]))
        return self._all("edges").where(F.col("batch") == batch).drop("batch")

    def _cuts(self, new: DataFrame) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
        """By length: how many reads are new and into how many segments all are cut from now on, 0 for too short ones; and into how many they were."""
        told = self._done("sizes").groupBy("size").agg(F.sum("n").alias("n"), F.max("parts").alias("parts")).collect()
        before = {r["size"]: r["parts"] for r in told}
        fresh = {r["size"]: r["n"] for r in new.groupBy(F.length("seq").alias("size")).agg(F.count("*").alias("n")).collect()}
        n = sum(r["n"] for r in told) + sum(fresh.values())
        wanted = {size: p for p, sizes in pairs.parts_for([*{*before, *fresh}], n, self.most).items() for size in sizes}
        return {size: (fresh.get(size, 0), max(wanted.get(size, 0), before.get(size, 0))) for size in {*before, *fresh}}, before

    def _edges(self, new: DataFrame, parts: dict[int, int], before: dict[int, int], first: int, batch: str) -> DataFrame:
        """(src, dst, weight), one end new. Every join has the new rows on one side; those of the index stay where they are."""
        work, by_parts = pairs.as_work(new), {p: sorted(s for s in parts if parts[s] == p) for p in {*parts.values()} - {0}}
        row = lambda df, role: df.select("h", F.lit(role).alias("role"), "vid", F.col("rest").alias("seq"))
        kept = [row(pairs.remainders(pairs.short_rows(work, self.most), self.most, "rest"), LEFT)]
        asked = []
        for p, sizes in by_parts.items():
            kept.append(row(pairs.keyed(work, self.most, p, True, sizes=sizes), p))
            if outgrown := [size for size in sizes if before.get(size, p) != p]:
                old = self._done("by_vid").select("vid", "seq").where(F.length("seq").isin(outgrown))
                kept.append(row(pairs.keyed(pairs.as_work(old), self.most, p, True, sizes=outgrown), p))
            ways = [w for w in pairs.plans(self.most, p, first > 0) if any([w[1], *w[4::3]])]
            if not first:  # among new reads alone the longer one asks, and of two of one length either may
                ways = [w for w in ways if w[1] or next(s for s in w[4::3] if s) > 0]
            if ways := [w for w in ways if any(size + w[1] in parts for size in sizes)]:
                asked.append(row(pairs.keyed(work, self.most, p, False, ways, sizes), p))
        self._append("hashes", reduce(DataFrame.union, kept).select("*", F.lit(batch).alias("batch")))
        every = self._done("hashes", batch)
        mine = every.where((F.col("batch") == batch) & (F.col("vid") >= first))
        of = lambda df, v: df.select("h", F.col("vid").alias(v), F.col("seq").alias(f"s{v}"))
        met = lambda one, two: of(one, "a").hint("merge").join(of(two, "b").hint("merge"), "h").select("a", "sa", "b", "sb")
        left = F.col("role") == LEFT
        own = every.where(self._cut_so(parts))
        common = own.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > self.often).select("h")
        frequent = stored(common, "frequent")
        crowded = bool(frequent.head(1))
        rare = own.hint("merge").join(frequent.hint("merge"), "h", "left_anti") if crowded else own
        made = [met(every.where(left), mine.where(left)).where("a < b"), met(rare, mine.where(~left)).where("a < b")]
        made += [met(rare, rows).where("a <> b") for rows in asked]
        found = [pairs._weighed(x, 1, self.most) for x in made]
        if crowded:
            # reads of any batch that have a segment which is frequent and that new reads have or ask for
            theirs = reduce(DataFrame.union, [mine.where(~left).drop("batch"), *asked]).hint("merge").join(frequent, "h", "left_semi")
            theirs = stored(theirs.select("h", "vid"), "asking")
            have = own.hint("merge").join(theirs.hint("merge"), "h", "left_semi").select("vid")
            dense = have.union(theirs.select("vid")).distinct()
            letters = self._done("by_vid", batch).select("vid", "seq")
            groups = stored(letters.hint("merge").join(dense, "vid", "left_semi"), "dense")
            both = reduce(DataFrame.union, pairs.dense_candidates(pairs.as_work(groups), self.most, self.often)).where("a <> b")
            both = both.where(F.greatest("a", "b") >= first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            found.append(pairs.verified(both, groups, 1, self.most))
        return reduce(DataFrame.union, found).distinct()

    @staticmethod
    def _cut_so(parts: dict[int, int]) -> Column:
        """Whether a row is of the segments that reads of its length are cut into now."""
        return reduce(Column.__or__, ((F.col("role") == p) & F.length("seq").isin([s for s in parts if parts[s] == p]) for p in {*parts.values()} - {0}), F.lit(False))

    def vertices(self) -> DataFrame:
        """(vid, seq, cnt) of all committed batches."""
        counts = self._done("counts").groupBy("vid").agg(F.sum("cnt").alias("cnt"))
        return self._done("by_vid").select("vid", "seq").join(counts, "vid")

    def edges(self) -> DataFrame:
        """(src, dst, weight) of all committed batches."""
        return self._done("edges").select("src", "dst", "weight")
