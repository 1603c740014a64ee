import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandgraph.functions import kmers
from strandgraph.functions.params import Scheme
from strandgraph.operators import buckets

READS = ["ACGTACGTACGT", "AAAAAAAA", "ACG", "ACGT", "ACGTACN", "TTGACCATTGACCAGGT", "A", "CCGTTAGGCATCAGATTTACAGGACATTAC"]


def md5(*parts):
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def words(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def gaps(s, k):
    return [s[i : i + 2 * k - 1 : 2] for i in range(len(s) - 2 * k + 2)]


def counted(ws, first=1):
    return [(w, ws[:i].count(w) + first) for i, w in enumerate(ws)]


def minima(xs, w):
    return {min(xs[i : i + w]) for i in range(len(xs) - w + 1)}


def column(spark, expr):
    rows = spark.createDataFrame([(s,) for s in READS], "seq string").select("seq", expr.alias("x")).collect()
    return {r.seq: r.x for r in rows}


def test_words(spark):
    assert column(spark, kmers.kmers(F.col("seq"), 4)) == {s: words(s, 4) for s in READS}
    assert column(spark, kmers.gapped(F.col("seq"), 3)) == {s: gaps(s, 3) for s in READS}
    got = column(spark, kmers.with_occurrence(kmers.kmers(F.col("seq"), 2)))
    assert {s: [(w.word, w.occ) for w in x] for s, x in got.items()} == {s: counted(words(s, 2)) for s in READS}


def test_occurrences_of_repeats_and_long_reads(spark):
    read = "ACAC" * 2000
    words_ = [read[i : i + 2] for i in range(len(read) - 1)]
    (row,) = spark.createDataFrame([(read,)], "seq string").select(kmers.with_occurrence(kmers.kmers(F.col("seq"), 2), 0).alias("x")).collect()
    assert [(w.word, w.occ) for w in row.x] == [(w, i // 2) for i, w in enumerate(words_)]


def test_segments(spark):
    got = column(spark, kmers.segments(F.col("seq"), 3))
    assert got["ACGTACGTACGT"] == ["ACGT"] * 3 and got["ACGTACN"] == ["AC", "GT", "ACN"] and got["A"] == ["", "", "A"]


def test_minimizers(spark):
    got = column(spark, kmers.lexicographic_minimizers(F.col("seq"), 4, 3))
    assert {s: set(x) for s, x in got.items()} == {s: minima(words(s, 4), min(3, len(words(s, 4)))) if len(s) >= 4 else set() for s in READS}
    got = column(spark, kmers.hashed_minimizers(F.col("seq"), 4, 3, 7, kmers.hash_md5))
    for s in READS:
        want = minima([md5("7", w) for w in words(s, 4)], 3)
        assert set(got[s] or []) == want


def test_sketches(spark):
    got = column(spark, kmers.gapped_min_hashes(F.col("seq"), 3, [5, 6], kmers.hash_md5))
    for s in READS:
        assert got[s] == [min((md5(str(seed), w, str(o)) for w, o in counted(gaps(s, 3))), default=None) for seed in (5, 6)]
    assert column(spark, kmers.prefix_sketch(F.col("seq"), 3, 2))["ACGT"] == "ACG|CGT"
    assert column(spark, kmers.prefix_sketch(F.col("seq"), 4, 2))["ACG"] is None
    got = column(spark, kmers.order_min_sketch(F.col("seq"), 3, 2, 9, kmers.hash_md5))
    for s in READS:
        ranked = sorted((md5("9", w, str(o)), i, w) for i, (w, o) in enumerate(counted(words(s, 3), 0)))[:2]
        assert got[s] == ("|".join(w for _, w in sorted((i, w) for _, i, w in ranked)) if len(s) >= 3 else None)


def test_deletions(spark):
    def brute(s, n):
        out, last = {s}, {s}
        for _ in range(n):
            last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
            out |= last
        return out

    got = column(spark, kmers.deletions(F.col("seq"), 2))
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(brute(s, 2)) for s in READS}


@pytest.mark.parametrize("variant", ["prefix", "minhash"])
def test_short_reads_get_no_sketch_key(spark, variant):
    v = spark.createDataFrame([(0, "ACG"), (1, "ACGTAC")], "vid long, seq string")
    assert {r.vid for r in buckets.sketches(v, 5, 2, [1, 2], variant).collect()} == {1}
    assert {r.vid for r in buckets.hashed(v, Scheme(4, 4)).collect()} == set()
    assert {r.key for r in buckets.gapped(v, [(1, 4)], hash_of=kmers.hash_md5).collect()} == {"0"}
    assert buckets.gapped(v, [(1, 4)], every=True).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=20), st.integers(1, 5))
def test_reference_definitions_agree(s, k):
    assert len(gaps(s, k)) == max(0, len(s) - 2 * k + 2) and all(len(g) == k for g in gaps(s, k))
