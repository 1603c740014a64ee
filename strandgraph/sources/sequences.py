"""Readers of sequence files and writers of graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.operators.storage import stored

#: Ambiguity letters and U, and what stands for them.
AMBIGUOUS, PLAIN = "URYSWKMBDHV", "TNNNNNNNNNN"


def letters(seq: Column, on_bad: str = "fail") -> Column:
    """Sequences over A, C, G, N, T. Other letters are an error when met, or give null with on_bad="null"."""
    clean = F.translate(F.upper(F.regexp_replace(seq, r"\s+", "")), AMBIGUOUS, PLAIN)
    bad = F.raise_error(F.concat(F.lit("not a sequence: "), F.substring(clean, 1, 40))) if on_bad == "fail" else F.lit(None).cast("string")
    return F.when(clean.rlike("^[ACGNT]+$"), clean).otherwise(bad.cast("string"))


def read_fasta(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """(id, seq): records may span lines. Spark splits the file at record marks, so one large file is read by many tasks."""
    # a mark only counts at the start of a line; the first record's stands at the start of the file
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    named = records.select(F.trim(F.regexp_replace(head, "\r$", "")).alias("id"), body.alias("body")).where("trim(body) <> ''")
    return named.select("id", letters(F.col("body"), on_bad).alias("seq"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines (file, base, value) that come in the order of their split, and single lines of those that are not whole here."""
    split, seen, waiting = None, 0, None
    for batch in chain(batches, [None]):
        if batch is None:
            lines = waiting
        else:
            # a line's number is the base of its split and its place among the split's lines, which follow each other
            own = np.stack([batch["file"].to_numpy(), batch["base"].to_numpy()], axis=1)
            if not len(own):
                continue
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            if split == tuple(own[0]):
                place[: first[1] if len(first) > 1 else len(own)] += seen
            split, seen = tuple(own[-1]), int(place[-1]) + 1
            new = pa.table({"file": own[:, 0], "at": own[:, 1] + place, "value": batch["value"].cast(pa.string())})
            lines = pa.concat_tables([waiting, new]) if waiting is not None else new
        if lines is None or not lines.num_rows:
            continue
        file, at, n = lines["file"].to_numpy(), lines["at"].to_numpy(), lines.num_rows
        start = np.flatnonzero(at[: max(n - 3, 0)] % 4 == 0)
        for i in range(1, 4):
            start = start[(file[start + i] == file[start]) & (at[start + i] == at[start] + i)]
        alone = np.ones(n, dtype=bool)
        for i in range(4):
            alone[start + i] = False
        alone = np.flatnonzero(alone)
        keep = alone[alone >= n - 3] if batch is not None else alone[:0]
        alone = alone[: len(alone) - len(keep)]
        waiting = lines.take(keep)
        rows = np.concatenate([start, alone])
        whole = np.arange(len(rows)) < len(start)
        value = lines["value"].combine_chunks()
        part = lambda i: value.take(pa.array(rows + np.where(whole, i, 0), mask=~(whole | (at[rows] % 4 == i))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(file[rows]), pa.array(at[rows] // 4), part(0), part(1), pc.utf8_slice_codeunits(part(2), 0, 1), pc.utf8_length(part(3)), pa.array(whole)],
            ["file", "record", "head", "seq", "mark", "size", "whole"],
        )


def read_fastq(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """(id, seq) of four-line records. The mark of a record may begin a quality line, so lines are counted, not matched; blank
    ones are not counted. A record that is cut after its letters, has no "+" line, or has not one quality for each letter is an error.

    Spark splits large files and unpacks compressed ones (a compressed file is one task). Lines are counted by splits first; a prefix
    sum over the splits of a file, one row each, turns places into line numbers. As lines are read again, in order, records
    are put together where they are read; only the lines of those that lie in two splits are shuffled.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")})
    sizes = stored(lines.groupBy("file", "block").agg(F.count("*").alias("n")), "splits")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    number = F.dense_rank().over(Window.orderBy("file")).cast("long")
    bases = sizes.select("file", "block", number.alias("number"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = lines.join(F.broadcast(bases), ["file", "block"]).select(F.col("number").alias("file"), "base", F.rtrim("value").alias("value"))
    # of the last two lines only what is checked is kept: that there is a mark, and how long the quality is
    told = stored(placed.mapInArrow(_put_together, "file long, record long, head string, seq string, mark string, size int, whole boolean"), "records")
    # a name without any further line is no record
    cut = told.where("not whole").groupBy("file", "record").agg(*(F.max(c).alias(c) for c in ("head", "seq", "mark", "size"))).where("seq is not null")
    records = told.where("whole").drop("whole").unionByName(cut)
    said = F.concat(F.lit("line "), (4 * F.col("record") + 1).cast("string"))
    whole = F.coalesce((F.col("mark") == "+") & (F.col("size") == F.length("seq")), F.lit(False))
    wrong = F.when(~F.col("head").startswith("@"), F.lit(" does not start a record")).when(~whole, F.lit(" starts a record without a mark or without a quality for each letter"))
    checked = records.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(said, wrong)).cast("boolean")))
    return checked.select(F.expr("substring(head, 2)").alias("id"), letters(F.col("seq"), on_bad).alias("seq"))


_ENDINGS = {"fasta": (".fasta", ".fa", ".fna"), "fastq": (".fastq", ".fq"), "parquet": (".parquet",)}


def _kind(name: str) -> str | None:
    plain = name.lower().rstrip("/*").removesuffix(".gz")
    return next((kind for kind, endings in _ENDINGS.items() if plain.endswith(endings)), None)


def read_sequences(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """FASTA, FASTQ or a Parquet table with a ``seq`` column: by the ending of the path, else of a file that it leads to."""
    kind = _kind(path)
    if kind is None:
        # names only; no content is read
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").first()
        kind = (found and _kind(found["path"])) or "parquet"
    if kind == "fasta":
        return read_fasta(spark, path, on_bad)
    if kind == "fastq":
        return read_fastq(spark, path, on_bad)
    table = spark.read.parquet(path)
    return table.withColumn("seq", letters(F.col("seq"), on_bad))


def write_fastq(records: DataFrame, path: str) -> None:
    """Records (id, seq) as four-line FASTQ; a ``qual`` column, where there is one, gives the quality lines."""
    quality = F.col("qual") if "qual" in records.columns else F.repeat(F.lit("I"), F.length("seq"))
    records.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), quality).alias("value")).write.text(path)


def dot_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): Graphviz lines; part 0 opens, 1 vertices, 2 edges, 3 closes."""
    spark = vertices.sparkSession
    v = vertices.select(F.lit(1).alias("part"), F.format_string('%d [count="%d", read="%s"];', "vid", "cnt", "seq").alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.format_string('%d--%d [weight="%d"];', "src", "dst", "weight").alias("line"))
    ends = spark.createDataFrame([(0, "graph G {"), (3, "}")], "part int, line string")
    return v.union(e).union(ends)


def write_dot(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Graphviz in files whose names and lines are in order, so that one after the other they are one graph; a small graph is
    one file. No task holds all lines."""
    dot_lines(vertices, edges).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def write_tables(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def write_bucket_stats(stats: DataFrame, path: str) -> None:
    """Tab-separated, with a header line in each file."""
    names = {"bucket_size": "BucketSize", "total_pairs": "TotalPairs", "positive_cases": "PositiveCases", "negative_cases": "NegativeCases"}
    stats.select(*(F.col(a).alias(b) for a, b in names.items())).write.csv(path, sep="\t", header=True)
