import gzip
import random

import pytest

from strandgraph.sources import fastq, sequences


def text(name, n, seed=0):
    """Records whose quality lines begin with "@" and "+", some with blank lines behind them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choices("ACGT", k=rng.randint(1, 60)))
        quality = rng.choice("@+I") + "".join(rng.choices("@+I", k=len(seq) - 1))
        out.append(f"@{name}{i} x\n{seq}\n+{rng.choice(['', name + str(i)])}\n{quality}\n" + rng.choice(["", "", "\n", " \r\n"]))
    return "".join(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cut(path, size):
    """All records of a file, read in ranges of ``size`` bytes."""
    parts = fastq.FastqReader(str(path), ["id", "seq"], size).partitions()
    return [r for part in parts for r in fastq.records(part)]


def test_cut_files_equal_whole_ones(tmp_path):
    (tmp_path / "a.fastq").write_text(text("a", 60))
    whole = cut(tmp_path / "a.fastq", 1 << 20)
    assert len(whole) == 60
    for size in (*range(1, 70), 128, 1000):
        assert cut(tmp_path / "a.fastq", size) == whole


def test_folder_through_spark_equals_reading_by_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text(text("a", 300))
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(text("b", 90, 1).encode()))
    (tmp_path / "in" / "_SUCCESS").write_text("")
    (tmp_path / "in" / "none.fastq").write_text("")
    want = rows(sequences.read_fastq(spark, f"{tmp_path}/in"))
    assert len(want) == 390
    assert rows(fastq.read_fastq_ranges(spark, f"{tmp_path}/in", size=500)) == want
    assert rows(fastq.read_fastq_ranges(spark, f"file:{tmp_path}/in/*.fastq*")) == want
    by_range = fastq.register(spark).read.format("fastq_ranges").option("rangeBytes", 500)
    assert by_range.load(f"{tmp_path}/in").columns == ["id", "seq", "qual"]
    only = by_range.option("columns", "seq").load(f"{tmp_path}/in")
    assert only.columns == ["seq"] and only.count() == 390
    assert fastq.read_fastq_ranges(spark, f"{tmp_path}/in/none.fastq").count() == 0


@pytest.mark.parametrize("bad", ["@c\nACGT\n", "@c\nACGT\n+\n", "@c\nACGT\n+\nIII\n", "@c\nACGT\nx\nIIII\n", "r\nAC\n+\nII\n", "ACGT\n"])
@pytest.mark.parametrize("tail", ["", "@d\nACG\n+\nIII\n"])
def test_records_that_are_not_whole_raise_wherever_files_are_cut(tmp_path, bad, tail):
    fine = text("a", 5)
    (tmp_path / "x.fq").write_text(fine + bad + tail)
    for size in (1, 3, 7, 20, 50, len(fine), len(fine) + 1, 1 << 20):
        with pytest.raises(ValueError, match=f"byte {len(fine)} "):
            cut(tmp_path / "x.fq", size)


def test_a_name_alone_is_no_record(tmp_path):
    (tmp_path / "x.fq").write_text(text("a", 9) + "@last\n")
    for size in (1, 5, 40, 1000):
        assert len(cut(tmp_path / "x.fq", size)) == 9
