import random

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import kmers
from strandgraph.jobs import catalog
from strandgraph.operators import components, graph, incremental, pairs, reads
from strandgraph.operators.storage import shared_folder, stored
from tests.test_graph import brute, levenshtein, rows, some_reads, table


def vertices_of(spark, seqs):
    return stored(reads.numbered(reads.multiplicity(table(spark, seqs))), "v")


def amplicon(r, n, errors):
    out = set()
    while len(out) < n:
        s = list(catalog.AMPLICON)
        for i in r.sample(range(60), errors):
            s[i] = r.choice("ACGT")
        if r.random() < 0.2:
            del s[r.randrange(60)]
        if r.random() < 0.2:
            s.insert(r.randrange(60), r.choice("ACGT"))
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("errors,often", [(3, 4), (2, 2), (5, 24)])
def test_dense_families_match_brute_force(spark, errors, often):
    seqs = amplicon(random.Random(errors), 260, errors)
    v = vertices_of(spark, seqs)
    found = stored(pairs.candidates(v, 2, often), "found")
    want = brute(seqs, 1, 2)
    assert want and rows(pairs.verified(found, v, 1, 2)) == want
    assert found.count() <= 20 * len(seqs) + 10 * len(want)
    assert found.count() == found.distinct().count()


def test_candidates_of_a_dense_family_stay_few(spark):
    """At most 20 a read and 10 for each edge, where all pairs would be 8 million."""
    v = stored(reads.numbered(reads.multiplicity(catalog.amplicon_of(spark.range(4000).select(F.col("id").alias("k")), F.lit(5)))), "v")
    found = stored(pairs.candidates(v, 2), "found")
    assert found.count() <= 20 * v.count() + 10 * pairs.verified(found, v, 1, 2).count()


@pytest.mark.parametrize("most,parts", [(1, 2), (1, 4), (2, 3), (2, 6), (3, 4)])
def test_plans_meet_all_pairs_within_reach(spark, most, parts):
    r, seqs = random.Random(parts), []
    for _ in range(40):
        a = "".join(r.choice("ACGT") for _ in range(r.randint(28, 44)))  # long enough, edited too, for segments
        b = a
        for _ in range(most):
            i = r.randrange(len(b))
            b = r.choice([b[:i] + "T" + b[i + 1 :], b[:i] + b[i + 1 :], b[:i] + "G" + b[i:]])
        seqs += [a, b]
    v = vertices_of(spark, seqs)
    found, frequent = pairs.segment_candidates(pairs.as_work(v), most, parts, None)
    met = {(min(a, b), max(a, b), d) for a, b, d in rows(pairs.verified(found.distinct(), v, 1, most))}
    assert frequent is None and met >= brute(seqs, 1, most)


def shaped(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").withColumn("weight", F.lit(1))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    parent = {i: i for e in edges for i in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    alone = {a for a, b in edges if a == b and all(a not in e for e in edges if e[0] != e[1])}
    got = {x.vid: x.comp for x in components.components(shaped(spark, edges)).collect()}
    assert got == {i: root(i) for i in parent if i not in alone}
    every = components.components(shaped(spark, edges), spark.createDataFrame([(i,) for i in [*parent, 9999]], "vid long"))
    assert {x.vid: x.comp for x in every.collect()} == {**{i: root(i) for i in parent}, 9999: 9999}
    assert components.components(shaped(spark, []).limit(0)).count() == 0


def test_walks_through_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 50)
    star = shaped(spark, [(0, i) for i in range(1, 2001)] + [(5000, 5001)])
    near, heavy = graph.adjacency(star)
    parts = near.where("node = 0").groupBy("part").count().collect()
    assert len(parts) == 40 == heavy.first()["parts"] and max(p["count"] for p in parts) < 120
    asked = spark.createDataFrame([(i, i + 1) for i in range(1, 2000)] + [(3, 5000), (0, 9)], "src long, dst long")
    assert graph.connected(asked, star, 2).count() == 2000
    assert {tuple(x) for x in graph.connected(asked, star, 1).collect()} == {(0, 9)}


def test_hops_add_what_a_traversal_of_all_pairs_adds(spark):
    seqs = some_reads(12, 150, 14)
    v = vertices_of(spark, seqs)
    one = stored(pairs.exact(v, 1, 1), "ones")
    met = {(min(x.src, x.dst), max(x.src, x.dst)) for x in graph.within_hops(one, None, 3).collect()}
    ones = rows(one)
    want = {e for e in brute(seqs, 1, 2) if e[:2] in met and e not in ones}
    assert rows(graph.verified_hops(one, v, None, 3, 1, 2)) == want


def grown(spark, batches, often=pairs.OFTEN, most=2):
    made = incremental.GrowingGraph(spark, f"{shared_folder(spark)}/growing-test-{random.random()}", most, 3, often)
    return made, [made.add(table(spark, b)) for b in batches]


@pytest.mark.parametrize("often", [2, 24])
def test_batches_make_the_graph_of_one_build(spark, often):
    r = random.Random(often)
    seqs = some_reads(21, 120) + some_reads(22, 60, 12) + amplicon(r, 60, 2)
    seqs += r.sample(seqs, 40)
    r.shuffle(seqs)
    batches = [seqs[:90], seqs[90:200], [], seqs[200:], seqs[:10]]
    made, told = grown(spark, batches, often)
    numbered = {x.vid: (x.seq, x.cnt) for x in made.vertices().collect()}
    every = [s for b in batches for s in b]
    assert sorted(numbered) == list(range(len(set(every)))) and all(every.count(s) == n for s, n in numbered.values())
    first = {s: next(i for i, b in enumerate(batches) if s in b) for s in set(every)}
    assert [numbered[i][0] for i in sorted(numbered)] == sorted(set(every), key=lambda s: (first[s], s))
    want = {(i, j, d) for i in numbered for j in numbered if i < j and abs(len(numbered[i][0]) - len(numbered[j][0])) < 3 and 1 <= (d := levenshtein(numbered[i][0], numbered[j][0])) <= 2}
    assert rows(made.edges()) == want and made.edges().count() == len(want)
    assert set().union(*map(rows, told)) == want and told[2].count() == 0 == told[4].count()
    again = incremental.GrowingGraph(spark, made.folder, 2, 3, often)
    assert rows(again.edges()) == want


def test_a_batch_that_was_lost_is_not_read(spark):
    made, _ = grown(spark, [["ACGTACGTACGTACGTACGT", "TTTTTTTTTTTTTTTTTTTT"]])
    made._append("by_seq", spark.createDataFrame([(77, "ACGTACGTACGTACGTACGA", "lost")], incremental.TABLES["by_seq"][0]))
    made._append("edges", spark.createDataFrame([(0, 77, 1, "lost")], incremental.PLAIN["edges"]))
    assert made.edges().count() == 0
    made.add(table(spark, ["ACGTACGTACGTACGTACGA"]))
    assert {x.vid for x in made.vertices().collect()} == {0, 1, 2} and rows(made.edges()) == {(0, 2, 1)}


def test_the_index_is_not_dealt_out_again(spark):
    made, _ = grown(spark, [some_reads(31, 60)])
    every = made._done("hashes").where("role = 1").select("h", F.col("vid").alias("b"))
    delta = spark.createDataFrame([(1, 2)], "h long, a long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = delta.join(every, "h")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@pytest.mark.parametrize("window", [1, 2, 3, 7, 8, 40])
def test_window_minima(spark, window):
    r = random.Random(window)
    lists = [[r.randrange(50) for _ in range(n)] for n in (1, 2, 3, 7, 8, 9, 40, 120)]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", kmers.window_minima(F.col("x"), window).alias("m")).collect()
    for g in got:
        assert g.m == ([min(g.x[i : i + window]) for i in range(len(g.x) - window + 1)] if len(g.x) >= window else [min(g.x)])


def test_bucket_candidates_are_made_once(spark):
    r = random.Random(5)
    keys = [(str(k), v) for v in range(80) for k in r.sample(range(12), r.randint(1, 6))]
    b = spark.createDataFrame(keys, "key string, vid long")
    found = [(x.a, x.b) for x in pairs.bucket_candidates(b, block=7).collect()]
    own = {}
    for k, v in keys:
        own.setdefault(v, set()).add(k)
    assert sorted(found) == [(i, j) for i in range(80) for j in range(i + 1, 80) if own[i] & own[j]]
