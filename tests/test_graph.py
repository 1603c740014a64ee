import random

import pytest
from pyspark.sql import functions as F

from strandgraph.jobs.build import build, routed
from strandgraph.jobs.config import GraphConfig
from strandgraph.operators import buckets, graph, pairs, reads
from strandgraph.operators.storage import shared_folder, stored


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_reads(seed, n=60, length=20):
    r, out = random.Random(seed), []
    for _ in range(n // 6):
        base = "".join(r.choice("ACGT") for _ in range(length + r.randint(-2, 2)))
        for _ in range(6):
            s = base
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(s))
                s = r.choice([s[:i] + r.choice("ACGTN") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + r.choice("ACGT") + s[i:]])
            out.append(s)
    return out


def table(spark, seqs, parts=3):
    return spark.createDataFrame([(s, "x") for s in seqs], "seq string, vid string").repartition(parts)


def brute(seqs, low, high):
    v = sorted(set(seqs))
    return {(i, j, d) for i in range(len(v)) for j in range(i + 1, len(v)) if low <= (d := levenshtein(v[i], v[j])) <= high}


def rows(df):
    return {(r.src, r.dst, r.weight) for r in df.collect()}


@pytest.mark.parametrize("seed,length,most", [(1, 20, 1), (2, 20, 2), (3, 9, 2), (4, 24, 3), (5, 6, 2)])
def test_exact_pairs(spark, seed, length, most):
    seqs = some_reads(seed, length=length)
    v = reads.numbered(reads.multiplicity(table(spark, seqs)))
    v, want = stored(v, "v"), brute(seqs, 1, most)
    assert rows(pairs.exact(v, 1, most)) == want == rows(pairs.exact(v, 1, most, often=2))
    work = v.select(F.lit(0).cast("long").alias("grp"), "vid", F.col("seq").alias("rest"))
    assert rows(pairs.verified(pairs.deletion_candidates(work, most).distinct(), v, 1, most)) == want


def test_exact_pairs_of_mixed_lengths_and_primers(spark, monkeypatch):
    r, seqs = random.Random(4), []
    for n in (6, 8, 17, 18, 19, 20, 21, 60, 299):
        base = "".join(r.choice("ACGT") for _ in range(n))
        seqs += [base, base[:3] + base[4:], base[:5] + "A" + base[5:], base[:-2], base + "GT", base[:2] + "T" + base[2:-1] + "A"]
    primer = "ACGTTGCAAC"
    for f in range(30):
        base = "".join(r.choice("ACGT") for _ in range(14))
        seqs += [primer + base, primer + base[:4] + base[5:], primer[:4] + "T" + primer[5:] + base, primer + base + "C"]
    v = stored(reads.numbered(reads.multiplicity(table(spark, seqs))), "v")
    want = brute(seqs, 1, 2)
    assert rows(pairs.exact(v, 1, 2)) == want == rows(pairs.exact(v, 1, 2, often=10))
    # candidates follow the reads, not the pairs that share the primer
    assert pairs.candidates(v, 2, often=10).count() < 2 * len(want) < pairs.candidates(v, 2, often=10**6).count()


def test_vertices(spark):
    seqs = some_reads(1) + some_reads(1)[:5]
    got = reads.numbered(reads.multiplicity(table(spark, [*seqs, None], 5))).collect()
    assert sorted((r.vid, r.seq, r.cnt) for r in got) == [(i, s, seqs.count(s)) for i, s in enumerate(sorted(set(seqs)))]
    assert reads.numbered(reads.multiplicity(table(spark, []))).count() == 0


@pytest.mark.parametrize("mode", ["minimizer_gomh", "miniception_gomh", "miniception", "omh"])
@pytest.mark.parametrize("length", [12, 24])
def test_modes_are_precise(spark, mode, length):
    seqs = some_reads(7, 90, length)
    want = brute(seqs, 1, 2)
    config = GraphConfig(mode=mode, omh_k=6, miniception_k=4, miniception_w=5)
    made = build(table(spark, seqs), config)
    found = rows(made.edges)
    assert found and found <= want
    if length == 24:
        assert found == rows(build(table(spark, seqs[::-1], 7), config).edges)
    else:
        far = GraphConfig(mode=mode, min_distance=2, omh_k=6, miniception_k=4, miniception_w=5)
        assert rows(build(table(spark, seqs), far).edges) == {e for e in found if e[2] == 2}
    assert made.metrics["min_length"] == min(map(len, seqs))


def test_brute_force_mode_and_empty_input(spark):
    seqs = some_reads(8)
    assert rows(build(table(spark, seqs), GraphConfig(mode="brute_force", min_distance=2)).edges) == brute(seqs, 2, 2)
    assert build(table(spark, []), GraphConfig(mode="brute_force")).edges.count() == 0


@pytest.mark.parametrize("routing", ["buckets", "size"])
def test_large_buckets_only_add_true_edges(spark, routing):
    seqs = some_reads(9, 120)
    found = rows(build(table(spark, seqs), GraphConfig(bin_size_max=8, routing=routing)).edges)
    assert found and found <= brute(seqs, 1, 2)


def test_in_buckets_equals_a_join_of_buckets(spark, monkeypatch):
    seqs = some_reads(10, 120, 12)
    v = reads.numbered(reads.multiplicity(table(spark, seqs)))
    keys = buckets.sketches(v, 4, 2, [1, 2])
    v = stored(v, "v")
    exact = pairs.exact(v, 1, 2)
    want = rows(pairs.in_buckets(exact, keys))
    assert rows(pairs.bucket_pairs(keys, v, 1, 2)) == want == rows(pairs.bucket_pairs(keys, v, 1, 2, block=3))
    own = {}
    for r in keys.collect():
        own.setdefault(r.key, set()).add(r.vid)
    edges = rows(exact)
    assert want == {e for e in edges if any(e[0] in b and e[1] in b for b in own.values())}
    for most in (0, 10**6):  # either way of finding pairs
        monkeypatch.setattr(pairs, "PAIRS_A_READ", most)
        assert rows(pairs.among(keys, v, 1, 2, lambda: exact)) == want
    for s in pairs.bucket_stats(exact, keys).collect():
        n, b = len(own[s.key]), own[s.key]
        hits = sum(e[0] in b and e[1] in b for e in edges)
        assert (s.bucket_size, s.total_pairs, s.positive_cases, s.negative_cases) == (n, n * (n - 1) // 2, hits, n * (n - 1) // 2 - hits)


def test_routes(spark):
    sub = spark.createDataFrame([(1, k, v) for k in range(4) for v in (10, 11)] + [(2, 0, 1)] + [(3, k, k) for k in (0, 1)], "parent int, key int, vid int")
    near, far = routed(sub, 3, "buckets")
    assert {r.parent for r in near.collect()} == {3} and {r.parent for r in far.collect()} == {1}
    near, far = routed(sub, 3, "size")
    assert {r.parent for r in near.collect()} == {1} and far.count() == 0


def test_traversal(spark):
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(6)] + [(0, 2, 1)], "src long, dst long, weight int")
    got = {(r.src, r.dst) for r in graph.within_hops(chain, spark.createDataFrame([(0,)], "vid long"), 3).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4)}
    assert graph.within_hops(chain, None, 15).count() == 7 * 6
    assert graph.within_hops(chain.limit(0), None, 3).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 15])
def test_connected_pairs_are_those_of_the_traversal(spark, depth):
    r = random.Random(depth)
    edges = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(32)})
    e = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, weight int")
    asked = sorted({tuple(sorted(r.sample(range(33), 2))) for _ in range(60)})
    hops = {(x.src, x.dst) for x in graph.within_hops(e, None, depth).collect()}
    got = graph.connected(spark.createDataFrame(asked, "src long, dst long"), e, depth)
    assert sorted((x.src, x.dst) for x in got.collect()) == [p for p in asked if p in hops]
    assert graph.connected(spark.createDataFrame([], "src long, dst long"), e, depth).count() == 0


def test_lengths_in_a_build(spark):
    seqs = ["ACGTA", "ACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTACGA", "A" * 305]
    assert build(table(spark, seqs), GraphConfig(on_bad_length="drop")).metrics == {"n_unique": 2, "min_length": 20, "n_out_of_range": 0}
    made = build(table(spark, seqs))
    assert made.metrics["n_out_of_range"] == 2 and rows(made.edges) == {(2, 3, 1)}
    assert {(r.stage, r.measure): r.n for r in made.stages.collect()}["graph", "edges of weight any"] == 1
    with pytest.raises(Exception, match="read of length"):
        build(table(spark, seqs), GraphConfig(on_bad_length="fail"))
    for mode in ("minimizer_gomh", "omh"):
        empty = build(table(spark, []), GraphConfig(mode=mode))
        assert empty.edges.count() == 0 and empty.stages.where("stage = 'reads' and n > 0").count() == 0
    with pytest.raises(ValueError, match="on_bad"):
        GraphConfig(on_bad_length="ignore")


def test_no_temporary_folder_on_a_cluster():
    class Away:
        conf = {}
        sparkContext = type("C", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Away())


def test_edge_tables(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 2, 2)], "src long, dst long, weight int")
    assert rows(graph.without_weights(e, 1, 1)) == {(0, 2, 2), (1, 2, 2)}
    more = spark.createDataFrame([(0, 1, 9), (3, 4, 1), (3, 4, 1)], "src long, dst long, weight int")
    assert rows(graph.inserted(e, more)) == rows(e) | {(3, 4, 1)}
    assert {(r.weight, r.n) for r in graph.summary(e).collect()} == {(1, 1), (2, 2), (None, 3)}


def test_lengths(spark):
    t = table(spark, ["ACGTA", "ACGTAC", "A" * 300, "A" * 301])
    assert sorted((len(r.seq), r.length_ok) for r in reads.check_lengths(t).collect()) == [(5, False), (6, True), (300, True), (301, False)]
    assert reads.check_lengths(t, "drop").count() == 2
    with pytest.raises(Exception, match="read of length"):
        reads.check_lengths(t, "fail").collect()


def test_split(spark):
    b = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)], "key string, vid int")
    normal, large = buckets.split(b, 3)
    assert {r.key for r in normal.collect()} == {"b"} and {r.key for r in large.collect()} == {"a", "c"}
    assert buckets.union_keys([b, b]).count() == 6 and buckets.sizes(b).where(F.col("size") == 3).count() == 1
