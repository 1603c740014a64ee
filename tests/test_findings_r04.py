"""Findings of round 4, each by a small case."""

import random

import duckdb
import numpy as np
import pytest

from strandgraph.jobs import build, catalog
from strandgraph.jobs.config import GraphConfig
from strandgraph.operators import dense, graph, pairs, reads, short
from strandgraph.operators.storage import stored


def table(spark, seqs):
    return stored(reads.numbered(reads.multiplicity(spark.createDataFrame([(s,) for s in seqs], "seq string"))), "vertices")


def orders(spark, tmp_path, n):
    spark.range(n).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    return con


def test_f5_sketches_are_of_whole_reads(spark, tmp_path):
    """Reads that differ in their first letters are found by what they share behind them."""
    con = orders(spark, tmp_path, 400)
    got = sorted(map(tuple, catalog.edges_omh(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()["edges_omh"]).fetchall())
    begin = {r.vid: r.seq[:7] for r in catalog.vertices_of(spark, str(tmp_path), 24).collect()}
    assert sum(begin[src] != begin[dst] for src, dst, _ in got) > 50


@pytest.mark.parametrize("least", [1, 2])
def test_f4_edges_of_short_reads_are_not_stored(spark, tmp_path, monkeypatch, least):
    """Edges and counts of the stages are those that each stage makes for itself, but only tables of reads and of bucket sizes are written."""
    orders(spark, tmp_path, 600)
    source, config = catalog.reads_of(spark, str(tmp_path), 12), GraphConfig(mode="minimizer_gomh", hash_name="md5", min_distance=least)
    monkeypatch.setattr(pairs, "PAIRS_A_READ", 0)
    shown = lambda made: (sorted(map(tuple, made.edges.collect())), sorted(map(tuple, made.stages.collect()), key=str))
    kept, names = build.stored, []
    monkeypatch.setattr(build, "stored", lambda df, name: names.append(name) or kept(df, name))
    got = shown(build.build(source, config))
    assert got[0] and "gapped" in names
    assert "edges" not in names
    monkeypatch.setattr(build, "without_walks", lambda *_: None)
    assert got == shown(build.build(source, config))


def crowd(seed, n, longest):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice("ACGT") for _ in range(draw.randint(0, longest))) for _ in range(n)} | {"ACCA" + "".join(draw.choice("AC") for _ in range(draw.randint(2, longest - 4))) for _ in range(n)})


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(now[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
        last = now
    return last[-1]


def test_f1_numbers_of_reads_tell_one_edit(spark):
    seqs = sorted({"", "A", "C", "T", "CA", "AA", "A" * 14, "A" * 15, "T" * 15, "T" * 14 + "A"} | set(crowd(3, 60, 7)) | set(crowd(4, 60, 15)))
    told = {r.seq: r.code for r in spark.createDataFrame([(s,) for s in seqs], "seq string").select("seq", short.codes("seq").alias("code")).collect()}
    numbers = np.array([told[s] for s in seqs], dtype=np.uint32)
    got = short._close(numbers[:, None], numbers[None, :])
    assert got.tolist() == [[abs(len(a) - len(b)) < 2 and edits(a, b) < 2 for b in seqs] for a in seqs]


@pytest.mark.parametrize("seed", [1, 2])
def test_f1_walks_are_looked_for_where_pairs_are_found(spark, monkeypatch, seed):
    """Pairs of weight 2 are neither stored nor joined with edges."""
    monkeypatch.setattr(short, "BLOCK", 100)  # larger groups are dealt into parts
    monkeypatch.setattr(short, "WALK", 7)
    v = table(spark, crowd(seed, 90, 13 + seed))
    one = stored(pairs.exact(v, 1, 1), "ones")
    want = sorted(map(tuple, graph.inserted(one, graph.verified_hops(one, v, None, 3, 1, 2)).collect()))
    twos = pairs.exact(v, 2, 2).count()
    assert 0 < sum(w == 2 for *_, w in want) < twos
    kept, names = short.stored, []
    monkeypatch.setattr(short, "stored", lambda df, name: names.append(name) or kept(df, name))
    assert sorted(map(tuple, short.walked_pairs(v).collect())) == want
    assert names == ["walks"]


def test_f1_longer_reads_and_other_letters_are_walked_by_joins(spark):
    assert short.walked_pairs(table(spark, ["ACGTACGTACGTACGT", "ACG"])) is None
    assert short.walked_pairs(table(spark, ["ACGN", "ACG"])) is None


@pytest.mark.parametrize("most", [1, 2, 3])
def test_f3_distances_of_long_reads(spark, most):
    """Batches of long pairs by their letters; the same as the SQL function, also for letters of several bytes."""
    draw = random.Random(most)
    seqs = {"", "A", "\u00e4\u00e9" * 30, "\u00e4\u00e9" * 29 + "\u00e9"} | {"A" * n for n in range(60, 66)} | {"AC" * 35, "CA" * 35, "AC" * 35 + "A"}
    for n in (7, 60, 66, 128, 150, 300):
        base = "".join(draw.choice("ACGT") for _ in range(n))
        seqs |= {base, base[1:], base[:-1], base[:-2], "A" + base, base + "CC", base[:20] + base[22:], base[:3] + "T" + base[4:-2] + "G" + base[-2:], base[:2] + base[3:-1] + "A" + base[-1:]}
    rows = [(i, a, j, b) for i, a in enumerate(sorted(seqs)) for j, b in enumerate(sorted(seqs)) if i < j]
    met = spark.createDataFrame(rows, "a long, sa string, b long, sb string")
    got = sorted(map(tuple, pairs._weighed(met, 1, most, True).collect()))
    assert got == sorted(map(tuple, pairs._weighed(met, 1, most).collect()))
    assert len(got) > 30


def test_f3_sub_buckets_of_builds_are_counted_from_lists(spark, monkeypatch):
    """Large buckets of long reads: the same edges and counts as from a row for each read of a sub-bucket, and none of these rows."""
    draw = random.Random(33)
    seqs = set()
    for n in range(51, 91, 8):
        base = "".join(draw.choice("ACGT") for _ in range(n))
        seqs |= {base, base[1:]} | {base[:at] + letter + base[at + 1 :] for at in range(n - 14, n) for letter in "ACGT"}
    source = stored(spark.createDataFrame([(s,) for s in sorted(seqs)], "seq string"), "source")
    config = GraphConfig(hash_name="md5", bin_size_max=40)
    shown = lambda made: (sorted(map(tuple, made.edges.collect())), sorted(map(tuple, made.stages.collect()), key=str))
    monkeypatch.setattr(build, "in_lists", lambda *_: None)
    want = shown(build.build(source, config))
    assert any(stage == "odd-sized buckets" and measure == "normal buckets" and n for stage, measure, n in want[1])
    monkeypatch.undo()
    monkeypatch.setattr(pairs, "PAIRS_A_READ", 1)
    monkeypatch.setattr(build.scheme, "COUNTED", 50)
    monkeypatch.setattr(build.scheme, "gapped_within", None)
    assert shown(build.build(source, config)) == want
    assert len(want[0]) > 40


def copies(seed, n, size, letters="ACGT"):
    """Copies of one sequence with a few substitutions, some with a letter moved."""
    draw = random.Random(seed)
    base = "".join(draw.choice(letters) for _ in range(n))
    seqs = {base}
    while len(seqs) < size:
        made = list(draw.choice([base, draw.choice(sorted(seqs))]))
        for _ in range(draw.randint(0, 3)):
            made[draw.randrange(n)] = draw.choice(letters)
        if draw.random() < 0.3:
            letter = made.pop(draw.randrange(n))
            made.insert(draw.randrange(n), letter)
        seqs.add("".join(made))
    return sorted(seqs)


@pytest.mark.parametrize(("n", "most", "letters"), [(60, 2, "ACGT"), (24, 2, "ACGT"), (33, 1, "ACGT"), (70, 2, "AC")])
def test_f2_copies_of_one_sequence_are_compared_in_groups(spark, monkeypatch, n, most, letters):
    """No candidate is shuffled, and each pair is given once, however small groups must be."""
    seqs = copies(n, n, 150, letters)
    v = table(spark, seqs)
    want = [(i, j, edits(a, b)) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if i < j]
    want = [x for x in want if 1 <= x[2] <= most]
    assert most == 1 or sum(sum(x != y for x, y in zip(seqs[i], seqs[j], strict=True)) > 2 for i, j, _ in want) > 10

    def never(*_):
        raise AssertionError("candidates are shuffled to be verified")

    monkeypatch.setattr(pairs, "verified", never)
    for large, rows in ((1 << 11, 1 << 15), (3, 7)):
        monkeypatch.setattr(dense, "LARGE", large)
        monkeypatch.setattr(dense, "ROWS", rows)
        got = sorted(map(tuple, pairs.exact(v, 1, most).collect()))
        assert [x for x in want if x not in set(got)][:3] == []
        assert got == want
