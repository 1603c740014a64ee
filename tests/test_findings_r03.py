"""Findings of round 3, each by a small case."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandgraph.functions import kmers
from strandgraph.jobs import build, catalog
from strandgraph.jobs.config import GraphConfig
from strandgraph.operators import buckets, graph, incremental, pairs, reads, short
from strandgraph.operators.storage import shared_folder, stored
from strandgraph.sources import sequences

READS = ["ACGTACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTACGTACGA", "ACGTACCTACGTACGTACGTACGT", "TTGCATTGCAGGATCCATTGACCA", "TTGCATTGCAGGATCCATTGACC"]


def table(spark, seqs):
    return stored(reads.numbered(reads.multiplicity(spark.createDataFrame([(s,) for s in seqs], "seq string"))), "vertices")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_f1_lists_of_keys_are_not_broadcast(spark):
    v = table(spark, READS)
    keys = stored(buckets.hashed(v, buckets.Scheme(4, 8), 2024, kmers.hash_md5), "buckets")
    found = pairs.bucket_candidates(keys)
    assert found.count() > 0
    assert "Broadcast" not in final_plan(found)


@pytest.mark.parametrize("what", ["inserted", "connected"])
def test_f2_edges_are_not_broadcast(spark, what):
    edges = stored(spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 2), (5, 6, 1)], "src long, dst long, weight int"), "edges")
    asked = spark.createDataFrame([(0, 3, 2), (0, 5, 2)], "src long, dst long, weight int")
    if what == "inserted":
        made = graph.inserted(edges, asked)
        assert made.count() == 6
    else:
        made = graph.connected(asked, edges, 3)
        assert [(r.src, r.dst) for r in made.collect()] == [(0, 3)]
        made = graph.walked(edges.select(edges.src.alias("start"), edges.src.alias("node")), *graph.adjacency(edges))
    assert "Broadcast" not in final_plan(made)


def test_f13_walks_cross_edges_of_weight_two(spark, tmp_path):
    """Two families of orders that only edges of weight 2 join."""
    keys = [*range(172808, 172812), *range(297716, 297720)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = set(con.execute(catalog.oracle_sql()["khop_pairs"]).fetchall())
    got = {(r.src, r.dst) for r in catalog.khop_pairs(spark, str(tmp_path)).collect()}
    assert got == want
    assert len(got) > 2 * 4 * 3


def brute(v, most):
    rows = v.select("vid", "seq")
    other = rows.toDF("other", "seq2")
    met = rows.crossJoin(other).where("vid < other").select("vid", "other", F.levenshtein("seq", "seq2").alias("d"))
    return sorted(map(tuple, met.where(F.col("d").between(1, most)).collect()))


@pytest.mark.parametrize("most", [1, 2])
def test_f15_to_f24_pairs_are_verified_where_they_meet(spark, monkeypatch, most):
    """Without frequent segments no candidate is shuffled, into however many segments reads are cut."""
    draw = random.Random(most)
    seqs = set()
    for _ in range(12):
        base = "".join(draw.choice("ACGT") for _ in range(draw.randint(22, 26)))
        for _ in range(6):
            made = list(base)
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(made))
                made[at : at + draw.randint(0, 1)] = draw.choice(["", "A", "C", "G", "T"])
            seqs.add("".join(made))
    v = table(spark, sorted(seqs))
    want = brute(v, most)
    assert want

    def never(*_):
        raise AssertionError("candidates are shuffled to be verified")

    monkeypatch.setattr(pairs, "verified", never)
    for crowd in (4, 1e-5, 1e-9):
        monkeypatch.setattr(pairs, "CROWD", crowd, raising=False)
        assert sorted(map(tuple, pairs.exact(v, 1, most, often=100).collect())) == want


def crowd(seed, letters="ACGT", longest=13):
    """Short reads so close to each other that most have many neighbours."""
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for _ in range(90)} | {"ACCA" + "".join(draw.choice("AC") for _ in range(draw.randint(6, 15))) for _ in range(60)})


@pytest.mark.parametrize("most", [1, 2])
def test_f4_pairs_of_short_reads_are_found_once_and_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(short, "BLOCK", 100)  # larger groups are dealt into parts
    v = table(spark, crowd(most, "ACGTN"))
    limit = (most + 1) * pairs.SEGMENT_LEAST
    _, brief = pairs._searched(v, 1, most, pairs.OFTEN, [])
    rows = [(r.src, r.dst, r.weight) for r in brief.collect()]
    assert len(rows) == len(set(rows))
    size = {r.vid: len(r.seq) for r in v.collect()}
    assert sorted(rows) == [x for x in brute(v, most) if min(size[x[0]], size[x[1]]) < limit]
    assert final_plan(brief).count("Exchange") == final_plan(brief).split("FlatMapGroups")[1].count("Exchange")
    assert sorted(map(tuple, pairs.exact(v, 1, most).collect())) == brute(v, most)


def test_f4_other_letters_go_by_deletions(spark):
    v = table(spark, ["ACGTACGTACGX", "ACGTACGTACGT", "ACGTACGTACG", "acgtacgtacgt"])
    assert sorted(map(tuple, pairs.exact(v, 1, 2).collect())) == brute(v, 2)


def test_f5_pairs_of_buckets_are_verified_where_they_meet(spark, monkeypatch):
    v = table(spark, READS)
    keys = stored(buckets.lexicographic(v, buckets.Scheme(4, 3)), "buckets")
    want = sorted(map(tuple, pairs.in_buckets(pairs.exact(v, 1, 2), keys).collect()))
    assert want

    def never(*_):
        raise AssertionError("candidates are shuffled to be verified")

    monkeypatch.setattr(pairs, "verified", never)
    for least in (0, 1 << 20):  # the exact search, and the direct join
        monkeypatch.setattr(pairs, "PAIRS_A_READ", least)
        assert sorted(map(tuple, pairs.among(keys, v, 1, 2, block=2).collect())) == want


def test_f6_to_f11_edges_of_short_reads_are_not_joined_with_keys(spark):
    v = table(spark, crowd(5) + READS)
    schemes = [buckets.lexicographic(v, buckets.Scheme(4, 3)), buckets.hashed(v, buckets.Scheme(4, 8), 2024, kmers.hash_md5), buckets.gapped(v, [(1, 4)], every=True)]
    every = stored(pairs.exact(v, 1, 2), "exact")
    got = [tuple(r) for r in pairs.exact_in(v, [(b, ["key"]) for b in schemes], 1, 2).collect()]
    assert len(got) == len({x[:2] for x in got})
    for i, keys in enumerate(schemes):
        assert sorted(x[:3] for x in got if x[3] >> i & 1) == sorted(map(tuple, pairs.in_buckets(every, keys).collect()))
    few = stored(v.where("length(seq) < 16"), "short")
    plan = final_plan(pairs.exact_in(few, [(schemes[0], ["key"])], 1, 2))
    assert "Join" not in plan.split("FlatMapGroups")[0]


def test_f9_f10_f12_one_search_for_all_stages(spark, monkeypatch):
    """The counts and edges of the stages, each from its own joins, and of one search for all."""
    source = stored(spark.createDataFrame([(s,) for s in crowd(7)[::3]], "seq string"), "source")
    config = GraphConfig(mode="minimizer_gomh")
    monkeypatch.setattr(pairs, "PAIRS_A_READ", 0)
    shown = lambda made: (sorted(map(tuple, made.edges.collect())), sorted(map(tuple, made.stages.collect()), key=str))
    once = []
    kept = build.without_walks
    monkeypatch.setattr(build, "without_walks", lambda *a: once.append(kept(*a)) or once[-1])
    got = shown(build.build(source, config))
    assert got[0] and once[0] is not None
    monkeypatch.setattr(build, "without_walks", lambda *_: None)
    assert got == shown(build.build(source, config))


def test_f14_new_reads_meet_the_index_with_their_letters(spark, monkeypatch):
    """No candidate is shuffled, and segments that have become too few are made more, of old reads too."""
    draw = random.Random(14)
    bases = ["".join(draw.choice("ACGT") for _ in range(draw.randint(17, 27))) for _ in range(14)]

    def near(s):
        i = draw.randrange(len(s))
        return s[:i] + draw.choice(["", "A", "CC", s[i]]) + s[i + 1 :]

    batches = [sorted({near(near(s)) for s in bases for _ in range(2)}) for _ in range(3)]

    def never(*_):
        raise AssertionError("candidates are shuffled to be verified")

    monkeypatch.setattr(pairs, "verified", never)
    made = incremental.GrowingGraph(spark, f"{shared_folder(spark)}/growing-f14", 2, 3, often=100)
    for crowd_now, batch in zip((4, 1e-5, 1e-9), batches, strict=True):
        monkeypatch.setattr(pairs, "CROWD", crowd_now, raising=False)
        made.add(spark.createDataFrame([(s,) for s in batch], "seq string"))
    want = brute(stored(made.vertices(), "grown"), 2)
    assert sorted(map(tuple, made.edges().collect())) == want
    assert len(want) > 14


def test_f28_records_are_put_together_where_they_are_read(spark, tmp_path):
    """No line of a record that lies in one split is sorted or shuffled."""
    sequences.write_fastq(spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("ACGT").alias("seq")), f"{tmp_path}/in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        made = sequences.read_fastq(spark, f"{tmp_path}/in")
        assert sorted(int(r.id) for r in made.collect()) == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    shuffled = [int(x) for x in re.findall(r"Exchange.*?records written: (\d+)", metrics(made))]
    assert shuffled and max(shuffled) < 200


def metrics(df):
    """Each node of the plan that ran, with the rows its exchange wrote."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(plan.plan())
        elif name == "Exchange":
            found.append(f"Exchange records written: {plan.metrics().apply('shuffleRecordsWritten').value()}")
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return "\n".join(found)


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN", "ABCDEFGHIJKLMNOPQRSTUVWXYZäß"])
def test_f29_gapped_keys_of_batches_are_those_of_sql(spark, letters):
    draw = random.Random(3)
    seqs = ["".join(draw.choice(letters) for _ in range(n % 40)) for n in range(120)] + ["A" * 30, "", "ACACACACACACACAC"]
    v = table(spark, seqs)
    seeds = [(11, 4), (22, 4), (33, 4), (7, 14)]
    by_k = {4: [11, 22, 33], 14: [7]}
    want = v.select("vid", F.array_distinct(F.transform(F.concat(*(kmers.gapped_min_hashes(F.col("seq"), k, own, kmers.hash_md5) for k, own in by_k.items())), lambda h: F.coalesce(h, F.lit("0")))).alias("keys"))
    got = buckets.gapped_lists(v.select("vid", "seq"), seeds, kmers.hash_md5)
    assert {r.vid: sorted(r["keys"]) for r in got.collect()} == {r.vid: sorted(r["keys"]) for r in want.collect()}


def families(tmp_path, spark, n=16000):
    spark.range(n).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    return con


def test_f29_sub_buckets_are_counted_without_joins_of_reads(spark, tmp_path):
    con = families(tmp_path, spark)
    made = catalog.sub_bucket_routes(spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["sub_bucket_routes"]).fetchall()
    assert want
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert "Join" not in final_plan(made)


def test_f25_edges_meet_lists_and_no_sub_bucket_is_made(spark, tmp_path, monkeypatch):
    con = families(tmp_path, spark)
    want = con.execute(catalog.oracle_sql()["large_bucket_rebucket"]).fetchall()
    monkeypatch.setattr(buckets, "gapped_within", None)
    got = sorted(map(tuple, catalog.large_bucket_rebucket(spark, str(tmp_path)).collect()))
    assert got == sorted(want)
    assert got


def test_f26_rows_of_the_heaviest_keys_are_not_dealt_out_by_key(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HEAVY", 30)
    draw = random.Random(26)
    seqs = {"ACGTTGCA" + "".join(draw.choice("ACGT") for _ in range(16)) for _ in range(60)}
    few = {"TTTTGGCC" + "".join(draw.choice("ACGT") for _ in range(16)) for _ in range(27)}
    v = table(spark, sorted(few | seqs | {s[:12] + s[13:] for s in seqs} | {s[:20] + "C" + s[21:] for s in seqs}))
    keys = pairs.keyed(pairs.as_work(v), 2, 3, True)
    frequent = pairs.frequent_keys(keys, 24)
    assert max(r.n for r in frequent.collect()) > 30
    rare = pairs.lacking(keys, frequent)
    # the primer's rows are gone before the exchange by key
    assert "BroadcastHashJoin" in final_plan(rare).split("Exchange hashpartitioning", 1)[1]
    told = {r.h for r in frequent.collect()}
    every = sorted(map(tuple, keys.collect()))
    assert sorted(map(tuple, rare.collect())) == [x for x in every if x[0] not in told]
    assert sorted(map(tuple, pairs.sharing(keys, frequent).collect())) == [x for x in every if x[0] in told]
    assert sorted(map(tuple, pairs.exact(v, 1, 2).collect())) == brute(v, 2)
