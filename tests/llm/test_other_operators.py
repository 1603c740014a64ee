import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import chat, topk, warc


def brute_top(rows, is_query, k):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q)
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.2 * rng.normal(size=8)]) for i in range(230)]
    rows += [(300 + i, rows[3][1]) for i in range(60)]  # one vector many times: ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] + [0.0] * 7), (503, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, pivot string").repartition(3)
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, 5)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], schema)
    assert {tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0, 5).collect()} == {(0, 1, 1, 32768), (0, 2, 2, -65536)}
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0, 5).count() == 0


def test_top_k_of_odd_lengths_and_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 7)]) for i in range(80)] + [(90, [9e6, 1.0, 0.0])]
    odd = [(100 + i, []) for i in range(30)] + [(200, [1.0]), (201, [1.0] * 4)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, 5)
    want = brute_top(rows, lambda i: i % 10 == 0, 5) | brute_top(odd[:30], lambda i: i % 10 == 0, 5)
    assert {tuple(r) for r in got.collect()} == want


def test_each_length_among_its_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3 + i % 3)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = set()
    for size in (3, 4, 5):
        want |= brute_top([r for r in rows if len(r[1]) == size], lambda i: i % 10 == 0, 5)
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 10 == 0, 5).collect()} == want


def test_lengths_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 24)
    monkeypatch.setattr(topk, "RARE", 8)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(8)
    sizes = [4] * 150 + [1 + i % 90 for i in range(400)]  # most lengths have few vectors and no pivots
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=n)]) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = set()
    for n in set(sizes):
        want |= brute_top([r for r in rows if len(r[1]) == n], lambda i: i % 7 == 0, 5)
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 7 == 0, 5).collect()} == want


def test_a_tile_meets_a_block_once(spark, monkeypatch):
    made = []
    score = topk._score
    monkeypatch.setattr(topk, "_score", lambda members, tiles, k: made.append(tiles) or score(members, tiles, k))
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(1500)]
    topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 3 == 0, 5).count()
    n = [tiles.agg(F.count("*").alias("rows"), (F.sum(F.length("names")) / 8).alias("visits")).first() for tiles in made]
    assert sum(x["visits"] for x in n) > 20 * sum(x["rows"] for x in n)


def test_bounds_skip_annuli_and_vectors_of_clusters():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(32, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(256 * (centres[np.arange(6400) % 32] + 0.02 * rng.normal(size=(6400, 16))))
    pivots = np.floor(256 * centres)
    d = topk.distances(x, pivots)
    own, near = d.argmin(1), d.min(1)
    ring = (near[:, None] > np.quantile(near, np.arange(1, 8) / 8)).sum(1)
    a = topk.Annuli.__new__(topk.Annuli)
    cells = sorted(set(zip(own.tolist(), ring.tolist())))
    parts = [np.flatnonzero((own == p) & (ring == r)) for p, r in cells]
    norm = (x**2).sum(1)
    a.pivots, a.pivot = pivots, np.array([p for p, _ in cells])
    a.n, a.lo, a.hi, a.norm = (np.array([f(m) for m in parts]) for f in (len, lambda m: near[m].min(), lambda m: near[m].max(), lambda m: norm[m].max()))
    q = x[:64]
    least = np.sort(q @ x.T, axis=1)[:, -6].astype(np.int64)
    seeds, rest = a.visits(q, least, True, 5), a.visits(q, least, False, 5)
    opened = set(zip(np.r_[seeds[0], rest[0]].tolist(), np.r_[seeds[1], rest[1]].tolist()))
    assert len(opened) < 0.3 * 64 * len(cells)
    for i in range(64):  # nothing that reaches the threshold lies elsewhere
        assert {cells.index((own[j], ring[j])) for j in np.flatnonzero(q[i] @ x.T >= least[i])} <= {c for n, c in opened if n == i}
    total = 0
    for p in range(32):
        m = np.flatnonzero(own == p)
        m = m[np.argsort(near[m])]
        block = topk.Block(m.tolist(), near[m].tolist(), norm[m].tolist(), [r.tobytes() for r in x[m].astype("<i8")], 16)
        out, scored = block.best(np.array([-1]), least[:1], d[:1, p], q[:1], 10**6)
        assert set(out[0][1].tolist()) == {j for j in m.tolist() if q[0] @ x[j] >= least[0]}
        total += scored
    assert total < 0.2 * len(x)


def test_empty_vectors_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, []) for i in (0, 0, 10, 11, 12, 13, 14, 15, 16, 20)] + [(30, [1.0]), (31, [2.0])]
    got = topk.top_k(spark.createDataFrame(rows, schema).repartition(3), F.col("vec_id") % 10 == 0, 5).collect()
    best = {q: sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) for q in (10, 20, 30)}
    assert [v for _, v, _ in best[10]] == [0, 0, 11, 12, 13] and {s for _, _, s in best[10]} == {0}
    assert [v for _, v, _ in best[20]] == [0, 0, 10, 11, 12] and best[30] == [(1, 31, 256 * 512)]
    assert sorted(r.vec_id for r in got if r.query_id == 0) == sorted([10, 11, 12, 13, 14] * 2)
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e30, -1e30]), (1, [1.0, 2.0])], schema), F.col("vec_id") == 0, 5).collect()


def test_common_prefix_and_masks(spark):
    turn = "array<struct<role:string,text:string>>"
    shared = [("user", "hi"), ("assistant", "hello")]
    rows = [
        (1, shared + [("user", "q"), ("assistant", "good")], shared + [("user", "q"), ("assistant", "bad answer"), ("user", "no")]),
        (2, shared, shared),
        (3, None, shared),
        (4, [], []),
        (5, [("user", None)], [("user", "")]),
        (6, shared[:1], shared),
        (6, shared[:1], shared),
        (None, [("assistant", "ä日")], []),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], f"pair_id long, chosen {turn}, rejected {turn}, prompt string")
    got = chat.format_pairs(table).collect()
    assert len(got) == len(rows)
    by = {r.pair_id: r for r in got}
    assert by[1].n_common == 3 and by[1].prompt.endswith("<|im_start|>user\nq<|im_end|>\n")
    assert [by[1].chosen[s.start : s.end] for s in by[1].chosen_mask] == ["good<|im_end|>\n"]
    assert [by[1].rejected[s.start : s.end] for s in by[1].rejected_mask] == ["bad answer<|im_end|>\n"]
    assert by[2].n_common == 2 and by[2].chosen == by[2].rejected == "" and not by[2].chosen_mask
    assert by[3].n_common == 0 and by[3].chosen == "" and by[3].rejected.count("<|im_start|>") == 2
    assert by[4].prompt == "" and by[5].n_common == 1 and by[6].n_common == 1 and by[6].chosen == ""
    assert [by[None].chosen[s.start : s.end] for s in by[None].chosen_mask] == ["ä日<|im_end|>\n"]


def test_a_turn_of_millions_of_letters(spark):
    turn = "array<struct<role:string,text:string>>"
    text = "word " * 600_000
    table = spark.createDataFrame([(1, [("user", text), ("assistant", text)], [("user", text), ("assistant", text + "!")])], f"pair_id long, chosen {turn}, rejected {turn}")
    (row,) = chat.format_pairs(table).collect()
    assert row.n_common == 1 and len(row.prompt) > len(text)
    assert [row.rejected[s.start : s.end] for s in row.rejected_mask] == [text + "!<|im_end|>\n"]


def test_many_turns_cost_linear_time(spark):
    turn, took = "array<struct<role:string,text:string>>", []
    for n in (10_000, 80_000):
        said = [("assistant" if i % 2 else "user", f"t{i}") for i in range(n)]
        table = spark.createDataFrame([(1, said, [])], f"pair_id long, chosen {turn}, rejected {turn}").cache()
        table.count()
        began = time.time()
        (row,) = chat.format_pairs(table).select("chosen", "chosen_mask").collect()
        took.append(time.time() - began)
        assert len(row.chosen_mask) == n // 2
        assert all(row.chosen[s.start : s.end] == f"t{2 * k + 1}<|im_end|>\n" for k, s in enumerate(row.chosen_mask))
    assert took[1] < 15


def test_swapped_answers(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (2, 2, "user", "e"), (3, 0, "user", "f"), (1, 1, "assistant", "b"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, last string").repartition(3)
    got = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat.swapped_answers(table).collect()}
    a, b = ("user", "a"), ("assistant", "b")
    assert got[1] == ([a, b, b], [a, b, ("assistant", "d")])
    assert got[2][1] == [("user", "c")] and got[3] == ([("user", "f")], [("user", "f")]) and got[None][0] == [("", "")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_pairs(chat.swapped_answers(empty)).count() == 0


PAGE = '<html><head><title>A &amp; <b>B</b></title><script>var t="</p>";</script></head><body><!-- no --><p>One&nbsp;two</p><a class="x" href="/l?a=1&amp;b=2">Link</a><br>ü &lt;end&gt;</body></html>'


def test_derived_records_link_to_their_response(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (None, "http://c/", "<p>" + "x " * 50_000), (1, "http://a/", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string").repartition(2)
    source = warc.responses(pages)
    got = warc.derive(source).collect()
    assert len(got) == 2 * len(rows)
    payloads = {r.record_id: r.payload for r in source.collect()}
    for r in got:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert r.payload_digest == "sha256:" + hashlib.sha256(payloads[r.refers_to].encode()).hexdigest()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"WARC-Type: {r.record_type}\r\n" in r.header and f"WARC-Date: {warc.UNDATED}\r\n" in r.header and r.date == warc.UNDATED
    one = {r.record_type: r for r in got if r.target_uri == "http://a/"}
    assert one["conversion"].block == "A & B\nOne two\nLink\nü <end>"
    assert one["metadata"].block == f"title: A & B\r\nsource-Content-Type: text/html; charset=utf-8\r\nsource-Content-Length: {len(PAGE.encode())}\r\noutlink: /l?a=1&b=2 L a/@href\r\n"
    assert len({r.record_id for r in got}) == 2 * (len(rows) - 1)
    dated = source.withColumn("date", F.lit("2024-01-01T00:00:00Z"))
    assert all("WARC-Date: 2024-01-01T00:00:00Z\r\n" in r.header for r in warc.derive(dated).collect())
    named = warc.responses(pages, F.lit("2025-02-03T04:05:06Z"))
    assert {r.date for r in warc.derive(named).collect()} == {"2025-02-03T04:05:06Z"}
    assert {r.date for r in warc.derive(source, "2026-01-01T00:00:00Z").collect()} == {"2026-01-01T00:00:00Z"}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def records_of(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.col("page_id").cast("string"))
    return {(int(r.target_uri), r.record_type): r.block for r in warc.derive(warc.responses(rows)).collect()}


def test_no_value_begins_a_header_line(spark):
    url = "http://a.b/\r\nX-Evil: 1\n\x00y"
    pages = spark.createDataFrame([(1, url, "<p>x</p>")], "page_id long, url string, html string")
    records = warc.responses(pages).withColumn("http_headers", F.lit("HTTP/1.1 200 OK\r\nServer: a\nX-Evil: 2\r\n"))
    for r in warc.derive(records).collect():
        assert r.target_uri == url and "WARC-Target-URI: http://a.b/X-Evil: 1y\r\n" in r.header
        lines = r.header.split("\r\n") + (r.block.split("\r\n") if r.record_type == "metadata" else [])
        assert not any(line.startswith("X-Evil") for line in "\n".join(lines).split("\n"))


def test_entities_and_links(spark):
    text = "a&#8217;b &mdash; &#x1F600;&#65279;| &amp;lt; &nope; &#0; &#xD800; &#1114112; &#150; &eacute;&Eacute; x & y &#; &amp &copy;&"
    links = "<a href='/one'>1</a><A class=x HREF = /two>2</A><a data-href='/no' href=\"/t?a=1&amp;b=&#50;&#10;\">3</a><a name=x>4</a><!-- <a href='/hidden'> --><abbr href=/no>"
    got = records_of(spark, text, links, "<title>T &lt; <b>U</b></title><script>x", "<!-- <title>no</title> --><p>a<!-- b", "<title>open")
    want = "a\u2019b \u2014 \U0001f600\ufeff| &lt; &nope; \ufffd \ufffd \ufffd \u2013 éÉ x & y &#; &amp ©&"
    assert got[0, "conversion"] == want
    found = [x.removesuffix(" L a/@href") for x in got[1, "metadata"].split("\r\n") if x.startswith("outlink: ")]
    assert found == ["outlink: /one", "outlink: /two", "outlink: /t?a=1&b=2"]
    assert got[2, "metadata"].startswith("title: T < U\r\n") and got[2, "conversion"] == "T < U"
    assert got[3, "conversion"] == "a" and got[3, "metadata"].startswith("title: \r\n") and got[4, "metadata"].startswith("title: open\r\n")


@pytest.mark.parametrize("piece", ["<a ", "<", "<!--", "<script ", "<title>", "</script ", "<a href=", "<a href='", "& ", "&#1", " \n", "<p ", "<a href ", "<title"])
def test_hostile_pages_cost_linear_time(spark, piece):
    began = time.perf_counter()
    got = records_of(spark, piece * (5_000_000 // len(piece)))
    assert len(got) == 2 and time.perf_counter() - began < 60


def test_random_pages_survive(spark):
    r = random.Random(4)
    bits = ["<", ">", "<a href=\"", "\"", "</title>", "<title>", "<script>", "</script>", "<!--", "-->", "&amp;", "&lt;", " ", "\n", "x", "é"]
    rows = [(i, "u", "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(200)]
    got = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert got.count() == 400 and got.where("block is null or header is null").count() == 0
