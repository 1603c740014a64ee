import gzip

import pytest
from pyspark.sql import functions as F

from strandgraph.jobs import cli
from strandgraph.operators import pairs
from strandgraph.sources import sequences


def written(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path):
    path = written(tmp_path / "x.fasta", ">r1 x\nACGT\nacg\n>r2\nNNAC\n>r3 >odd\r\nAUR\r\nY\r\n")
    got = {r.id: r.seq for r in sequences.read_sequences(spark, path).collect()}
    assert got == {"r1 x": "ACGTACG", "r2": "NNAC", "r3 >odd": "ATNN"}
    assert sequences.read_fasta(spark, written(tmp_path / "none.fa", "")).count() == 0


def test_fastq(spark, tmp_path):
    path = written(tmp_path / "x.fastq", "@r1\nACGT\n+\n@@II\n@r2\nACG\n+r2\n@II\n")
    assert {r.id: r.seq for r in sequences.read_sequences(spark, path).collect()} == {"r1": "ACGT", "r2": "ACG"}
    assert sequences.read_fastq(spark, written(tmp_path / "none.fq", "")).count() == 0


def test_fastq_cut_and_compressed(spark, tmp_path):
    def text(name, n):
        return "".join(f"@{name}{i} x\n{'ACGT' * (i % 7 + 1)}\n+\n{'@III' * (i % 7 + 1)}\n" for i in range(n))

    want = sorted((f"{name}{i} x", "ACGT" * (i % 7 + 1)) for name, n in (("a", 300), ("b", 170)) for i in range(n))
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.fastq", text("a", 300))
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(text("b", 170).encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(f"{tmp_path}/in/a.fastq").rdd.getNumPartitions() > 5
        assert sorted(tuple(r) for r in sequences.read_fastq(spark, f"{tmp_path}/in").collect()) == want
        assert sorted(tuple(r) for r in sequences.read_sequences(spark, f"{tmp_path}/in/b.fastq.gz").collect()) == want[300:]
        assert sequences.read_fastq(spark, written(tmp_path / "end.fq", text("c", 60) + "@last\n")).count() == 60
        with pytest.raises(Exception, match="line 241 does not start a record"):
            sequences.read_fastq(spark, written(tmp_path / "bad.fq", text("c", 60) + "r\nAC\n+\nII\n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_that_is_not_whole(spark, tmp_path):
    fine = "@a\nACGT\n+\nIIII\n\n@b\nAC\n+b\n@I\r\n   \n"
    assert {tuple(r) for r in sequences.read_fastq(spark, written(tmp_path / "blank.fq", fine)).collect()} == {("a", "ACGT"), ("b", "AC")}
    for i, cut in enumerate(("@c\nACGT\n", "@c\nACGT\n+\n", "@c\nACGT\n+\nIII\n", "@c\nACGT\nx\nIIII\n", "@c\nACGT\n+\nIIIII\n")):
        with pytest.raises(Exception, match="line 9 starts a record without"):
            sequences.read_fastq(spark, written(tmp_path / f"{i}.fq", fine + cut)).collect()


def test_large_graph_files_are_ordered_parts(spark, tmp_path):
    v = spark.range(500).select(F.col("id").alias("vid"), F.lit("ACGT").alias("seq"), F.lit(1).cast("long").alias("cnt"))
    e = spark.range(499).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sequences.write_dot(v, e, f"{tmp_path}/dot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in (tmp_path / "dot").iterdir() if p.name.startswith("part-"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert len(parts) > 1 and len(lines) == 1001 and lines[0] == "graph G {" and lines[-1] == "}"
    assert all("--" not in x for x in lines[:501]) and all("--" in x for x in lines[501:-1])


def test_command_line_takes_real_numbers():
    args = cli.parser().parse_args(["-i", "a", "-o", "b", "--beta", "2.5", "--alpha", "1"])
    assert (args.beta, args.alpha) == (2.5, 1.0)


def test_folders_and_written_files(spark, tmp_path):
    records = spark.createDataFrame([(str(i), "ACGT" * (i % 5 + 2), "@" + "I" * (4 * (i % 5 + 2) - 1)) for i in range(40)], "id string, seq string, qual string").repartition(3)
    sequences.write_fastq(records, f"{tmp_path}/out")
    want = sorted((r.id, r.seq) for r in records.collect())
    assert sorted(tuple(r) for r in sequences.read_fastq(spark, f"{tmp_path}/out").collect()) == want
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.fastq", "@x\nACGT\n+\n@III\n")
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(b"@y\nAC\n+\n@I\n"))
    for path in (f"{tmp_path}/in", f"{tmp_path}/in/*.fastq*"):
        assert {tuple(r) for r in sequences.read_sequences(spark, path).collect()} == {("x", "ACGT"), ("y", "AC")}
    records.select("seq").write.parquet(f"{tmp_path}/table")
    assert sequences.read_sequences(spark, f"{tmp_path}/table").count() == 40


def test_letters(spark, tmp_path):
    path = written(tmp_path / "x.fa", ">r\nACGTX1\n>s\nAC\n")
    with pytest.raises(Exception, match="not a sequence"):
        sequences.read_fasta(spark, path).collect()
    assert {r.seq for r in sequences.read_fasta(spark, path, "null").collect()} == {None, "AC"}


def test_graph_files(spark, tmp_path):
    v = spark.createDataFrame([(0, "AC", 2), (1, "AT", 1)], "vid long, seq string, cnt long")
    e = spark.createDataFrame([(0, 1, 1)], "src long, dst long, weight int")
    sequences.write_dot(v, e, f"{tmp_path}/dot")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/dot").collect()]
    assert lines == ["graph G {", '0 [count="2", read="AC"];', '1 [count="1", read="AT"];', '0--1 [weight="1"];', "}"]
    buckets = spark.createDataFrame([("k", 0), ("k", 1)], "key string, vid long")
    sequences.write_bucket_stats(pairs.bucket_stats(e, buckets), f"{tmp_path}/tsv")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/tsv", sep="\t", header=True).collect()] == [("2", "1", "1", "0")]


def test_command_line(spark, tmp_path):
    path = written(tmp_path / "x.fasta", "".join(f">r{i}\n{s}\n" for i, s in enumerate(["ACGTACGTACGTACGTAC", "ACGTACGTACGTACGTAA", "TTTTTTTTTGGGGGGGGG", "ACGTACGTACGTACGTAC"])))
    cli.main(["-i", path, "-o", f"{tmp_path}/out", "--mode", "brute_force", "--on-bad-length", "drop", "--save-graph"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/edges").collect()] == [(0, 1, 1)]
    assert spark.read.parquet(f"{tmp_path}/out/vertices").count() == 3
    assert spark.read.text(f"{tmp_path}/out/graph.dot").count() == 6
    assert spark.read.csv(f"{tmp_path}/out/stages", sep="\t", header=True).where("stage = 'graph'").count() == 2
