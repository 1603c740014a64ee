import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import language, prefixtrie, whitening
from strandgraph.llm.shared import TextBatch
from tests.llm.cases import documents

# whitening


def kept(vectors):
    return [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def exact_covariance(x):
    n, size = len(x), len(x[0])
    mean = [Fraction(sum(r[d] for r in x), n) for d in range(size)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(size)] for i in range(size)])


def vectors(n=90, size=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) @ rng.normal(size=(size, size))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows + [(500, None), (501, [1.0, None] + [0.0] * (size - 2)), (502, [float("nan")] + [0.0] * (size - 1)), (503, [float("-inf")] * size), (None, rows[3][1]), (4, rows[4][1])]


def whitened(spark, rows, kind="float", components=8):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n string, size int").repartition(3)
    return whitening.whiten(table, components).collect()


@pytest.mark.parametrize("size", [6, 12])
def test_whitening_matches_exact_fractions(spark, size):
    rows = vectors(size=size)
    got, fine = whitened(spark, rows), kept(rows)
    x = [v for _, v in fine]
    n, top = len(x), min(8, size)
    total = [sum(r[d] for r in x) for d in range(size)]
    values, own = np.linalg.eigh(exact_covariance(x))
    values, own = values[::-1], own[:, ::-1]
    assert len(got) == n * top and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    far = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, total)] for v in x]) @ own[:, :top] / np.sqrt(values[:top])
    sign = [math.copysign(1, by[0, k + 1][0].whitened * far[0, k]) for k in range(top)]
    for (i, v), f in zip(fine, far):
        for k in range(top):
            assert any(r.whitened == pytest.approx(sign[k] * f[k], abs=1e-8) and r.deviation == sum((n * c - t) ** 2 for c, t in zip(v, total)) for r in by[i, k + 1])


def test_whitening_of_large_numbers_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in 1e10 + 1e9 * rng.normal(size=3)]) for i in range(40)]
    got = whitened(spark, rows, "double")
    x = [v for _, v in kept(rows)]
    total = [sum(r[d] for r in x) for d in range(3)]
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum((40 * c - t) ** 2 for c, t in zip(v, total))) for i, v in kept(rows)}
    assert max(r.identity_error for r in got) < 1e-9
    with pytest.raises(Exception, match="does not fit"):
        whitened(spark, [(1, [1e30, 1.0])], "double")


def test_whitening_without_variance_and_of_mixed_lengths(spark):
    assert whitened(spark, []) == [] == whitened(spark, [(1, None), (2, [])])
    one = whitened(spark, [(1, [0.5, 0.25])])
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in sorted(one)] == [(1, 0.0, 0.0, 0, 0.0), (2, 0.0, 0.0, 0, 0.0)]
    flat = whitened(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)])
    assert all(r.whitened == 0 for r in flat if r.component > 1) and {round(r.explained, 9) for r in flat} == {1.0, 0.0}
    assert max(r.identity_error for r in flat) < 1e-9
    both = whitened(spark, [(i, [float(i), float(i * i % 7)]) for i in range(9)] + [(20 + i, [float(i)]) for i in range(4)])
    assert {(r.n, r.component) for r in both} == {(9, 1), (9, 2), (4, 1)}


# language


def brute_logits(net, text):
    """Every window, position and filter by loops."""
    raw = text.encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    step, total, windows, at = language.STEP, 0, 0, 0
    while True:
        own = [raw[at + k] if at + k < len(raw) else language.PAD for k in range(language.WINDOW)]
        most = np.full(net.filters.shape[1], -np.inf)
        for p in range(language.WINDOW - language.WIDEST + 1):
            seen = np.concatenate([net.bytes_[own[p + k]] for k in range(language.WIDEST)])
            most = np.maximum(most, seen @ net.filters)
        total, windows, at = total + np.maximum(most + net.bias, 0) @ net.out + net.out_bias, windows + 1, at + step
        if at + language.WIDEST - 1 >= len(raw):
            return total / windows


def test_network_equals_loops_over_windows(spark):
    net = language.Network.fresh(["aa", "bb", "cc"], np.random.default_rng(2))
    texts = ["", "Ab", "x" * 124, "y" * 128 + "z", "Ünï çode " * 60, "The quick BROWN fox " * 30, None, "12 34", "日本語"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.predict(docs, net).collect()}
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        share = language.softmax(brute_logits(net, t)[None])[0]
        assert got[i].lang_pred == net.names[share.argmax()] and got[i].score == pytest.approx(share.max(), abs=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = language.Network.fresh(["a", "b"], rng)
    for name in ("bytes_", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    windows, label = rng.integers(97, 123, (6, language.WINDOW)), np.array([0, 1, 1, 0, 1, 0])

    def loss():
        return -np.log(language.softmax(net.logits(windows))[np.arange(6), label]).mean()

    grads, step = language.gradients(net, windows, label), 1e-6
    for w, g in zip(net.weights(), grads):
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)]:
            if w is net.filters and not language.mask()[at]:
                continue
            was = w[at]
            w[at] = was + step
            up = loss()
            w[at] = was - step
            down = loss()
            w[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_windows_cover_every_byte_run():
    text = TextBatch(pa.array(["", "abc", "q" * 500, "w" * 128]))
    row, at = language.cut(text, 0, 4)
    seen = {(r, a + p + k) for r, a in zip(row.tolist(), at.tolist()) for p in range(language.STEP) for k in range(language.WIDEST)}
    assert {(i, b) for i in range(4) for b in range(text.offsets[i], text.offsets[i + 1])} <= seen
    assert np.bincount(row).tolist() == [1, 1, 4, 1]
    assert (language.bytes_at(text, row, at)[0] == language.PAD).all()


def test_language_is_learned_without_the_held_out_rows(spark):
    r = random.Random(1)
    words = {"aa": "the and of to in that shall with from have".split(), "bb": "der und die das nicht ein mit sich auch von".split(), "cc": "que los una por con para este como más ño".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(3, 90))), k) for i, k in enumerate(r.choice(list(words)) for _ in range(500))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 $", "cc"), (903, "the of", None), (None, "die und", "bb"), (5, rows[5][1], rows[5][2])]
    # a wrong label on held-out rows must not matter
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    told = [(i, t, "cc" if held(i) else k, "s", "n") for i, t, k in rows]
    docs = spark.createDataFrame(told, "doc_id long, text string, lang string, source string, n string").repartition(3)
    got = language.identify(docs).collect()
    truth = {i: k for i, _, k in rows[:500]}
    assert len(got) == len(rows) and all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 for x in got)
    own = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(own) > 80 and np.mean([x.lang_pred == truth[x.doc_id] for x in own]) > 0.97
    assert {x.lang_pred for x in got if x.doc_id in (900, 901, 902)} == {"und"}
    assert language.labelled_windows(docs).count() <= language.SAMPLE


def test_sample_of_many_documents_takes_languages_by_turns(spark, monkeypatch):
    assert language.turns_for([5, 1000, 1000], 105) == 50 and language.turns_for([3, 4], 100) == 5 and language.turns_for([], 9) == 1
    monkeypatch.setattr(language, "SAMPLE", 300)
    lang = F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 2 == 0, "aa").otherwise("bb")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), lang.alias("lang"), F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    got = {r.lang: r["count"] for r in language.labelled_windows(docs).groupBy("lang").count().collect()}
    assert sum(got.values()) == 300 and got["rare"] >= 40 and min(got["aa"], got["bb"]) > 90


def test_language_of_odd_tables(spark):
    docs = documents(spark)
    got = language.identify(docs).collect()  # no row has a language
    assert len(got) == docs.count() and {(x.lang_pred, x.score) for x in got} == {("und", 0.0)}
    assert language.identify(documents(spark, [])).count() == 0
    one = docs.drop("lang").withColumn("lang", F.lit("xx"))
    assert {(x.lang_pred, round(x.score, 6)) for x in language.identify(one).collect()} == {("xx", 1.0), ("und", 0.0)}


# prefix trie


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            told = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            key = (-math.inf if turn is None else turn, hashlib.sha256(told.encode()).hexdigest())
            own.setdefault(c, []).append((key, (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - math.fmod(c, 5), [])[:h] + turns[h:]
    return trie(built)


def trie(built):
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        under = [m for m in members if m[: len(node)] == node]
        kids = {m for m in under if len(m) == len(node) + 1}
        leaves = [m for m in under if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in under)]
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(node))))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        above = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), above, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, n string, size int"


def got_trie(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in prefixtrie.trie_of(table).collect()), key=str)


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_trie_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK_TURNS", block)
    r = random.Random(block)
    rows = []
    for c in [*range(0, 70), -3, -5, 10**12]:
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "hello", "ok", "ünï"])))
    rows += [(71, None, "user", "first"), (71, 0, None, None), (71, 0, None, None), (72, 1, "user", ""), (72, 1, "a", "b"), (None, 0, "user", "lost")]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(3)]  # one conversation many times
    assert got_trie(spark, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_a_long_conversation(spark, monkeypatch):
    assert got_trie(spark, []) == []
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(3000)] + [(10, t, "user", f"turn {t % 7}") for t in range(2990)]
    monkeypatch.setattr(prefixtrie, "BLOCK_TURNS", 64)
    got = got_trie(spark, rows)
    assert len(got) == 3001 and {g[3] for g in got if g[1] <= 2990} == {2} and {g[5] for g in got} == {1}
    saved = {g[1]: g[6] for g in got}
    assert saved[2989] - saved[2990] == len(f"turn {2988 % 7}") and saved[2990] == len(f"turn {2989 % 7}") and saved[2991] == 0


def test_radix_tree_grows_through_all_layouts():
    tree, keys = prefixtrie.Tree(), []
    kinds = {}
    for i in range(256):
        key = b"shared" + bytes([i * 7 % 256]) + b"tail" * (i % 3)
        keys.append(key)
        tree.insert(key, i)
        node = tree.root.children.get(ord("s"))
        if i:
            kinds[i + 1] = (type(node.children).__name__, getattr(node.children, "room", None))
    assert (kinds[4], kinds[5], kinds[16], kinds[17], kinds[48], kinds[49]) == (("Few", 4), ("Few", 16), ("Few", 16), ("Many", None), ("Many", None), ("Full", None))
    tree.insert(b"shared", 900)
    tree.insert(b"sha", 901)
    tree.insert(b"", 902)

    def walk(node, before):
        at = before + node.path
        for name in node.ends:
            yield name, at
        for b in range(256):
            below = node.children.get(b) if node.children else None
            if below:
                yield from walk(below, at + bytes([b]))

    assert dict(walk(tree.root, b"")) == {**dict(enumerate(keys)), 900: b"shared", 901: b"sha", 902: b""}


def test_pieces_of_a_list_give_one_digest():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"a", b"b"]), pa.array(["1,2", "30", "7"])], ["node", "ends"])
    more = pa.RecordBatch.from_arrays([pa.array([b"b"]), pa.array(["8"])], ["node", "ends"])
    got = {n: d for b in prefixtrie._digest_of_pieces(iter([batch, more])) for n, d in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {b"a": hashlib.sha256(b"1,2,30").hexdigest(), b"b": hashlib.sha256(b"7,8").hexdigest()}
