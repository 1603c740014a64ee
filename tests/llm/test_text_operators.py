import hashlib
import pickle
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import decontam, jaccard, packing, pii, quality, tokencount, tokens, toxicity
from strandgraph.llm.shared import ALNUM, NON_SPACE, TextBatch, hash_spans
from tests.llm.cases import BASE, LONG, TEXTS, documents, labels

FRESH = Tokenizer.from_file(tokens.vocabulary_path())
ODD_TEXT = st.text(alphabet="abAB 09.\n\t\x0b\x00é日\x1c-@+|*", max_size=40)


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_words(text, pattern):
    return re.findall(pattern, low(text or ""))


SPACE_WORD, ALNUM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD_TEXT), max_size=6))
def test_words_of_a_batch(texts):
    for inside, pattern in ((NON_SPACE, SPACE_WORD), (ALNUM, ALNUM_WORD)):
        got, seen = [], {}
        batch = TextBatch(pa.array(["skip", *texts], pa.string()).slice(1))
        for _, _, counts, hashes, starts, ends in batch.words(inside):
            words = [low(batch.data[a:b].tobytes().decode()) for a, b in zip(starts, ends)]
            for w, h in zip(words, hashes.tolist()):
                assert seen.setdefault(w, h) == h
            at = 0
            for n in counts:
                got.append(words[at : at + n])
                at += n
        assert got == [plain_words(t, pattern) for t in texts]
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB'sSt \t\n1½É é́İıΣσς.,!\x00\x1c\x85　日<|endoftext>ǅ", max_size=20))
def test_ids_by_word_are_ids_of_the_text(text):
    memo = tokens.memo(tokens.vocabulary_path())
    assert memo.ids(text) == memo.whole(text)


MARKED = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "\x1c", "a", "B's", "9", ">", "\u0338", "é", "Σ", "日"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(MARKED)
def test_ids_are_those_of_an_unaltered_tokenizer(text):
    assert tokens.memo(tokens.vocabulary_path()).ids(text) == tokens.packed(FRESH.encode(text, add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(MARKED, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20), MARKED), max_size=3))
def test_recount_of_marks_that_edits_touch(text, edits):
    memo, edits = tokens.memo(tokens.vocabulary_path()), [(a, a + n, t) for a, n, t in edits]
    after = tokencount.edited(text, tokencount.accepted(edits, len(text)))
    tree = tokencount.Tree.unpacked(tokencount.tree_of(text, memo).packed())
    assert tree.sums.total == len(FRESH.encode(text, add_special_tokens=False).ids)
    assert tokencount.recount(text.encode(), tree, edits, memo)[0] == len(FRESH.encode(after, add_special_tokens=False).ids)


def test_packed_marks(spark):
    (row,) = packing.pack(documents(spark, [(1, "x <|endoftext|> y")]), with_ids=True).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [343, 49407, 344, 2] and row.doc_tokens == 4


def test_memory_of_words_is_bounded():
    memo = tokens.WordMemo(tokens.vocabulary_path(), most=3)
    text = "one two three four five six seven one two"
    assert memo.ids(text) == memo.whole(text)
    assert len(memo) <= 3 and len(memo.older) <= 3


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = plain_words(t, SPACE_WORD)
        out.setdefault(i, set()).update({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    return out


def brute_components(sets):
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    comp[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed, families=6, size=12, words=40):
    r = random.Random(seed)
    rows, i = [], 0
    passage = [f"p{j}" for j in range(60)]
    for f in range(families):
        base = [f"f{f}w{j}" for j in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.2:
                own += passage
            rows.append((i, " ".join(own)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 3)  # the list of common shingles then matters on few rows too
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(documents(spark, rows, extra=False)).collect()}
    sets = sets_of(rows)
    assert got == {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}


def test_jaccard_defined_results(spark):
    rows = jaccard.link(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1][1] == got[2][1] == got[3][1] == 1
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6) and got[7] == (1, 7)
    assert got[9][1] == 8
    assert jaccard.link(documents(spark, [])).count() == 0
    kept = jaccard.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 10, 11, 12, 13, None}


def test_one_row_is_kept_of_each_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " more"), (None, a), (None, c), (None, c), (3, b), (5, b), (5, "a text that only id five has"), (5, "a text that only id five has")]
    rows += [(6, a), (6, "a text that only id six has"), (7, None), (7, None), (7, ""), (8, None), (None, None)]
    kept = jaccard.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark).columns and kept.dtypes == documents(spark).dtypes
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([("1", a), ("None", c), ("3", b), ("5", "a text that only id five has"), ("6", "a text that only id six has"), ("7", ""), ("8", ""), ("None", "")])
    twice = [r for r in near_copies(6) for _ in range(2)]
    comp = brute_components(sets_of(twice))
    assert sorted(r.doc_id for r in jaccard.keep_one(documents(spark, twice)).collect()) == sorted(i for i in comp if comp[i] == i)
    assert jaccard.keep_one(documents(spark, [])).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (10, b + " more"), (11, "something else")]
    assert {(r.doc_id, r.component_id) for r in jaccard.link(documents(spark, rows)).collect()} == {(3, 3), (5, 3), (9, 3), (10, 3), (11, 11)}


def thue_morse(first, n):
    word = first
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_words_of_cancelling_structure_differ(spark):
    one, two = thue_morse("a", 1024), thue_morse("b", 1024)
    rows = [(1, "p q r s " + one), (2, "p q r s " + two), (3, one[:256]), (4, two[:256]), (5, one[:16]), (6, two[:16])]
    assert {r.doc_id: r.component_id for r in jaccard.link(documents(spark, rows)).collect()} == {i: i for i in range(1, 7)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20), st.integers(0, 700))
def test_spans_hash_by_their_folded_bytes_alone(parts, longer):
    parts = [*parts, b"X" * longer, b"x" * longer]
    raw, cuts = np.frombuffer(b"".join(parts) or b"-", np.uint8), np.cumsum([0, *map(len, parts)])
    got = hash_spans(raw, cuts[:-1], cuts[1:]).tolist()
    folded = [p.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for p in parts]
    assert all((folded[i] == folded[j]) == (got[i] == got[j]) for i in range(len(parts)) for j in range(i))
    alone = [hash_spans(np.frombuffer(p or b"-", np.uint8), np.array([0]), np.array([len(p)]))[0] for p in parts]
    assert got == alone


def test_common_shingles_only_cost_time(spark, monkeypatch):
    rows = near_copies(3)
    docs, sets = documents(spark, rows, extra=False), sets_of(rows)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}
    every = np.unique(np.concatenate(list(jaccard.shingle_sets(pa.array([t for _, t in rows]))))) >> np.uint64(24)
    for told in (every, np.sort(np.concatenate([every[::3], np.random.default_rng(1).integers(0, 1 << 40, 500).astype(np.uint64)]))):
        monkeypatch.setattr(jaccard, "common_shingles", lambda docs, bits, told=told: told)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()} == want


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_common_shingles_are_counted_over_all_documents(spark, held, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 3)
    monkeypatch.setattr(jaccard, "HELD", held)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 25)))) for i in range(60)] + [(90, None)]
    seen = {}
    for s in {x.tobytes(): x for x in jaccard.shingle_sets(pa.array([t for _, t in rows]))}.values():
        for x in s[: 2 * len(s) // 5 + 1].tolist():
            seen[x >> 24] = seen.get(x >> 24, 0) + 1
    got = jaccard.common_shingles(documents(spark, rows).coalesce(1), 8)
    assert got.tolist() == sorted(x for x, n in seen.items() if n > 3)


def test_cell_joins_each_component_once():
    cell = jaccard.Cell()
    one = np.arange(20, dtype=np.uint64)
    for name in range(5):
        cell.add(name, name % 2, one)
    found = cell.ask(9, 9, one)
    assert len(found) == 2 and cell.ask(9, 9, one) == []
    assert cell.ask(10, 10, np.arange(100, 120, dtype=np.uint64)) == []


def brute_hits(text, items):
    w = plain_words(text, ALNUM_WORD)
    hit, found = set(), set()
    for item, t in items:
        p = plain_words(t, ALNUM_WORD)
        size = min(10, len(p))
        windows = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if p and item is not None else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [1 << 19, 40])
def test_decontamination_matches_brute_force(spark, block_words, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontam, "TOGETHER", 3)
    r = random.Random(5)
    items = [(i, " ".join(r.choice("a b c".split()) for _ in range(r.randint(0, 14)))) for i in range(12)]
    items += [(100, BASE), (101, None), (None, "two words"), (3, "Two  WORDS"), (102, "a")]
    rows = TEXTS + [(200 + i, " ".join(r.choice("a b c d".split()) for _ in range(60))) for i in range(30)]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, block string, size int")
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.report(documents(spark, rows), bench).collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    kept = decontam.keep_clean(documents(spark, rows), bench)
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, t in rows if not brute_hits(t, items)[4])


@pytest.mark.parametrize("chunk", [1, 1 << 25])
def test_decontamination_reads_documents_once_for_many_blocks(spark, chunk, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 64)
    monkeypatch.setattr(decontam, "CHUNK_BYTES", chunk)
    r = random.Random(11)
    long = " ".join(f"w{r.randrange(40)}" for _ in range(500))
    items = [("long", long), *((f"i{i}", " ".join(f"w{r.randrange(40)}" for _ in range(12))) for i in range(30))]
    words = long.split()
    rows = [(i, " ".join(["none of it", *words[a : a + r.randint(8, 40)], "either", *r.choice(items)[1].split()[: r.randint(8, 12)]])) for i, a in enumerate(range(0, 460, 9))]
    rows += [(1000, None), (1001, ""), (1002, long), (1002, long), (1003, "clean words only " * 50)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert decontam.pattern_blocks(bench).count() >= 8
    docs = documents(spark, rows).repartition(2)
    report = decontam.report(docs, bench)
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in report.collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    kept = decontam.keep_clean(docs, bench)
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, t in rows if not brute_hits(t, items)[4])
    for made in (report, kept):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_overlapping_runs_become_one():
    runs = np.array([[1, 4, 9], [0, 2, 5], [0, 4, 6], [0, 6, 8], [0, 10, 12], [1, 5, 6], [3, 0, 1]])
    assert decontam.merged_runs(runs).tolist() == [[0, 2, 8], [0, 10, 12], [1, 4, 9], [3, 0, 1]]
    assert decontam.merged_runs(runs[:0]).tolist() == []


def test_tables_of_a_large_benchmark_are_small():
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, 4 << 20).astype(np.uint8)
    gaps = np.cumsum(rng.integers(3, 10, 700_000))
    letters[gaps[gaps < len(letters)]] = 32
    cut = np.linspace(0, len(letters), 20_001).astype(int)
    texts = pa.array([letters[a:b].tobytes().decode() for a, b in zip(cut[:-1], cut[1:])])
    ids = pa.array([str(i) for i in range(len(texts))])
    tracemalloc.start()
    block = decontam.build(ids, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(p.at) for p in block.patterns) > 450_000
    assert peak < 200 << 20 and len(pickle.dumps(block, protocol=5)) < 60 << 20
    found = decontam.scan(pa.array([texts[5].as_py() + " and " + texts[9].as_py(), "nothing of it"]), block)
    assert {block.names[i] for _, i in found.items.tolist()} == {"5", "9"} and set(found.runs[:, 0].tolist()) == {0}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {x.n_hit for x in decontam.report(documents(spark), none).collect()} == {0}
    assert decontam.report(documents(spark, []), none).count() == 0


BASE_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_pii(text):
    out = []
    for kind, p in enumerate(BASE_PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == 0) or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 16 <= len(d) <= 19 and pii.luhn(d)) or (kind == 3 and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet="ab@.-1 +é", max_size=40), st.text(alphabet="0123456789 .-+()", max_size=60), st.text(alphabet="41 -", max_size=40)))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_addresses_of_thousands_of_digits(spark):
    many, zeros = "1" * 5000, "0" * 5000 + "7"
    rows = [(1, f"{many}.1.1.1 and 1.2.3.{many} and {zeros}.1.2.{zeros}"), (2, f"+{many} {many}@x.org")]
    got = {r.doc_id: (r.n_ip, r.n_email, r.n_phone) for r in pii.detect(documents(spark, rows)).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 1, 0)}


def test_look_alikes_of_one_endless_word():
    began = time.perf_counter()
    text = "a1." * 200_000 + " (at home) bob (at) x (dot) org"
    found = pii.nodes(text, pii.base_spans(text))
    assert [x.token for x in found] == ["bob@x.org"]
    assert time.perf_counter() - began < 30


def test_pii_query_and_field(spark):
    got = {r.doc_id: r for r in pii.detect(documents(spark)).collect()}
    for i, t in TEXTS:
        base = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == j for b in base) for j in range(4)]
        assert set(pii.written(base).split(",")) <= set(got[i].spans.split(","))
    assert got[10].n_added == 2  # the address around its sign, and the number without its prefix
    assert pii.detect(documents(spark, [])).count() == 0
    red = {r.doc_id: r for r in pii.redact(documents(spark)).collect()}
    assert red[10].text == "Mail <email> or <email>, call <phone> or <phone>; <ip> and 999.1.1.1"
    assert red[10].n_chars == len(red[10].text) and red[1].text == BASE and red[4].text is None


def phone_field(unary):
    k = pii.OTHER + 1
    return pii.Field({"digits 10": np.array([-3.0, -3, -3, unary, 0])}, np.zeros((k, k)))


@pytest.mark.parametrize("unary", [-3.0, -2.0, -1.0, 0.0])
@pytest.mark.parametrize("repeats", [1, 2, 3, 4, 8, 20, 99, 200])
@pytest.mark.parametrize("gap", [" ", " " + "x" * 100 + " "])
def test_every_repeat_of_an_observed_span_is_labelled(repeats, unary, gap):
    gap = " and" + gap
    for before in {0, repeats // 2, repeats}:
        text = gap.join(["(499) 555-6503"] * before + ["+1 (499) 555-6503"] + ["(499) 555-6503"] * (repeats - before))
        base, spans = pii.all_spans(text, phone_field(unary))
        assert len(base) == 1 and len(spans) == 1 + repeats and {k for k, _, _ in spans} == {3}


def test_look_alikes_of_a_document_without_base_spans(spark):
    texts = ["write to jane (at) corp (dot) org", "jane (at) corp (dot) org" + " or" * 60 + " jane (at) corp (dot) org", "a (at) b.org, 555-010-4477 and" + " or" * 60 + " c (at) d.org"]
    rows = [(i, f"user{i}@x.org") for i in range(60)] + [(100 + i, t) for i, t in enumerate(texts)] + [(200, "no node here"), (201, None)]
    field = pii.learn(documents(spark, rows))
    assert field.unary["address"][0] > 1
    got = {r.doc_id: r.n_added for r in pii.detect(documents(spark, rows)).collect()}
    assert [got[100 + i] for i in range(3)] == [1, 2, 2] and got[200] == got[201] == got[5] == 0
    red = {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}
    assert red[100] == "write to <email>" and red[200] == "no node here"
    # what a document is told does not hang on a base span elsewhere in it
    assert pii.redacted("jane (at) corp (dot) org" + " or" * 60 + " 10.0.0.1", field).startswith("<email>")
    flat = pii.Field({}, np.zeros((pii.OTHER + 1, pii.OTHER + 1)))
    assert pii.all_spans(texts[0], flat) == ([], [])


def test_messages_settle_on_long_chains():
    rng, n, k = np.random.default_rng(1), 300, 3
    unary, tables = rng.normal(size=(n, k)) / 9, np.repeat(4 * np.eye(k)[None], n - 1, 0)
    # forward and backward sums, exact on a chain
    ahead, behind = np.zeros((n, k)), np.zeros((n, k))
    for i in range(1, n):
        ahead[i] = np.logaddexp.reduce((ahead[i - 1] + unary[i - 1])[:, None] + tables[i - 1], 0)
        ahead[i] -= ahead[i].max()
    for i in range(n - 2, -1, -1):
        behind[i] = np.logaddexp.reduce((behind[i + 1] + unary[i + 1])[None] + tables[i], 1)
        behind[i] -= behind[i].max()
    want = np.exp(unary + ahead + behind)
    got = pii.beliefs(unary, np.column_stack([np.arange(n - 1), np.arange(1, n)]), tables)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=2e-2)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(0)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    table = rng.normal(size=(3, 3, 3))
    want = np.zeros((4, 3))
    for state in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(table[e, state[a], state[b]] for e, (a, b) in enumerate(edges)))
        for i, s in enumerate(state):
            want[i, s] += p
    got = pii.beliefs(unary, edges, table)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_packing_is_a_partition_of_the_tokens(spark):
    memo = tokens.memo(tokens.vocabulary_path())
    pieces = packing.pack(documents(spark), size=64, with_ids=True)
    rows = pieces.collect()
    want = sorted(memo.ids(t) + b"\2\0" for _, t in TEXTS)
    by_sequence, joined = {}, {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
        start = r.sequence_id * 64 + r.offset - r.start
        joined.setdefault((start, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for q, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or q == max(by_sequence)
    texts = [b"".join(i for _, i in sorted(p)) for p in joined.values()]
    assert sorted(np.frombuffer(t, "<u4").astype("<u2").tobytes() for t in texts) == want
    for r in packing.sequences(pieces, 64).collect():
        assert len(r.ids) == 4 * r.n_tokens and r.padded == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 64)
    assert packing.pack(documents(spark, [])).count() == 0


def test_recount_is_the_count_of_the_edited_text(spark):
    memo, r = tokens.memo(tokens.vocabulary_path()), random.Random(3)
    letters = "ab c's  \n.!é1\x1c\u3000日"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        edits = [(a := r.randint(0, len(text) + 1), a + r.randint(0, 4), "".join(r.choice(letters) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(0, 4))]
        after = tokencount.edited(text, tokencount.accepted(edits, len(text)))
        tree = tokencount.Tree.unpacked(tokencount.tree_of(text, memo).packed())
        assert tokencount.recount(text.encode(), tree, edits, memo)[0] == len(memo.whole(after)) // 2
    got = tokencount.apply_edits(tokencount.build_trees(documents(spark)), tokencount.cleaning).collect()
    want = {i: (len(memo.ids(t)) // 2, len(memo.ids(tokencount.edited(t or "", tokencount.accepted(tokencount.cleaning(t or ""), len(t or ""))))) // 2) for i, t in TEXTS}
    assert len(got) == len(TEXTS) and {x.doc_id: (x.n_tokens, x.n_tokens_after) for x in got} == want
    assert all(x.n_renewed <= x.n_leaves for x in got)


def test_edits_of_any_whole_numbers(spark):
    for kind in ("tinyint", "int", "bigint"):
        docs = spark.createDataFrame([(1, "one two three", [(4, 7, "2 2")]), (2, "x", None)], f"doc_id long, text string, edits array<struct<start:{kind},end:{kind},text:string>>")
        assert {(r.doc_id, r.n_edits) for r in tokencount.apply_edits(tokencount.build_trees(docs)).collect()} == {(1, 1), (2, 0)}
    far = spark.createDataFrame([(1, "one", [(1 << 40, 1 << 41, " end")])], "doc_id long, text string, edits array<struct<start:bigint,end:bigint,text:string>>")
    assert tokencount.apply_edits(tokencount.build_trees(far)).first().n_edits == 1
    with pytest.raises(ValueError, match="no column edits"):
        tokencount.apply_edits(tokencount.build_trees(documents(spark)))


def test_edited_trees_are_those_of_the_edited_texts(spark):
    r, memo, letters = random.Random(8), tokens.memo(tokens.vocabulary_path()), "ab é日\n \t<.'1"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["", "word " * 300]

    def proposed(text):
        own = random.Random(text)
        return [(a := own.randint(0, len(text) + 1), a + own.randint(0, 5), "".join(own.choice(letters) for _ in range(own.randint(0, 5)))) for _ in range(own.randint(0, 5))]

    for text in texts:
        now, tree = text, tokencount.tree_of(text, memo)
        for _ in range(3):  # each round begins from the tree that the last one left
            edits = proposed(now + " ")
            raw, tree = tokencount.spliced(now.encode(), tree, edits, memo)
            now = tokencount.edited(now, tokencount.accepted(edits, len(now)))
            fresh = tokencount.tree_of(now, memo)
            assert raw.decode() == now and tree.packed() == fresh.packed()
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").repartition(3)
    trees = tokencount.build_trees(docs)
    for _ in range(3):
        trees = tokencount.edited_trees(trees, proposed)
    want = {99: ""}
    for i, text in enumerate(texts):
        for _ in range(3):
            text = tokencount.edited(text, tokencount.accepted(proposed(text), len(text))) if text else text
        want[i] = text
    got = {x.doc_id: (x.text, x.n_tokens, bytes(x.tree)) for x in trees.collect()}
    assert got == {i: (t, len(memo.whole(t)) // 2, tokencount.tree_of(t, memo).packed()) for i, t in want.items()}
    more = spark.createDataFrame([(99, 0, 0, "new")], "doc_id long, start long, end long, text string")
    assert {x.doc_id: x.n_tokens_after for x in tokencount.apply_edits(tokencount.with_edits(trees, more)).collect()}[99] == len(memo.whole("new")) // 2


def test_recount_from_a_table_of_edits(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "same")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 4, 7, "2 2"), (1, 5, 6, "overlaps"), (2, 0, 0, "new text"), (9, 0, 1, "x")], "doc_id long, start long, end long, text string")
    memo = tokens.memo(tokens.vocabulary_path())
    got = {r.doc_id: r for r in tokencount.apply_edits(tokencount.build_trees(tokencount.with_edits(docs, edits))).collect()}
    assert got[1].n_tokens_after == len(memo.ids("one 2 2 three")) // 2 and got[1].n_edits == 1 and got[1].n_renewed == 1
    assert got[2].n_tokens_after == len(memo.ids("new text")) // 2 and got[3].n_tokens_after == got[3].n_tokens


def test_segment_tree():
    tree = tokencount.SegmentTree(np.arange(7))
    tree.set(6, 10)
    tree.set(0, 5)
    assert tree.total == 5 + 1 + 2 + 3 + 4 + 5 + 10 and tokencount.SegmentTree(np.zeros(0)).total == 0
    leaves, r = np.arange(1000), random.Random(2)
    tree = tokencount.SegmentTree(leaves)
    for _ in range(50):
        i, value = r.randrange(1000), r.randrange(1 << 17)
        tree.set(i, value)
        leaves[i] = value
    assert tree.total == leaves.sum() and [len(x) for x in tree.levels] == [1000, 63, 4, 1]


def test_an_odd_sign_renews_only_its_leaf():
    memo = tokens.memo(tokens.vocabulary_path())
    text = "one two\x1cthree " + "four " * 500
    tree = tokencount.tree_of(text, memo)
    assert len(tree.starts) == 502 and tree.sums.total == len(memo.whole(text)) // 2
    after = text[:20] + "x" + text[20:]
    assert tokencount.recount(text.encode(), tree, [(20, 20, "x")], memo) == (len(memo.whole(after)) // 2, 1, 1)


def test_recount_reads_only_edited_regions():
    class Watched(bytes):
        read = 0

        def __getitem__(self, where):
            Watched.read += len(range(*where.indices(len(self))))
            return super().__getitem__(where)

    memo, text = tokens.memo(tokens.vocabulary_path()), "wörd " * 2000
    tree = tokencount.Tree.unpacked(tokencount.tree_of(text, memo).packed())
    want = len(memo.ids(text[:5000] + "new" + text[5002:])) // 2
    assert tokencount.recount(Watched(text.encode()), tree, [(5000, 5002, "new")], memo)[0] == want and Watched.read < 40


def test_counts_with_a_clashing_column_and_of_nothing(spark):
    docs = documents(spark).withColumn("edits", F.lit("not a list"))
    assert tokencount.apply_edits(tokencount.build_trees(docs), tokencount.cleaning).count() == len(TEXTS)
    assert tokencount.apply_edits(tokencount.build_trees(documents(spark, [])), tokencount.cleaning).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.floats(0.1, 3)), min_size=1, max_size=25))
def test_segments_are_maximal(words):
    at = np.array([i for i, (hit, _) in enumerate(words) if hit], int)
    weights = np.array([w for hit, w in words if hit])
    scores = [w if hit else -0.37 for hit, w in words]

    def best(lo, hi):
        found = [(sum(scores[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = max(found, default=(0, 0, 0))
        if top[0] <= 1e-9:
            return []
        a, b = -top[1], -top[2]
        return best(lo, a) + [(a, b)] + best(b, hi)

    got = toxicity.segments(at, weights, 0.37)
    assert sum(s for _, _, s in got) == pytest.approx(sum(sum(scores[a:b]) for a, b in best(0, len(scores))))


def classified(spark, kind):
    r, rows, marks = random.Random(1), [], []
    for i in range(300):
        text = " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 120)))
        bad = i % 4 == 0
        if bad and kind == "toxic":
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
            text = " ".join(w)
        if bad and kind == "quality":
            text = " ".join(w + "***" for w in text.split())
        rows.append((1000 + i, text))
        marks.append((1000 + i, int(not bad), int(bad)))
    return documents(spark, TEXTS + rows), labels(spark, marks + [(1, None, None), (None, 1, 1), (7, 1, 0)])


@pytest.mark.parametrize("kind,module", [("quality", quality), ("toxic", toxicity)])
def test_classifiers_on_held_out_rows(spark, kind, module):
    docs, marks = classified(spark, kind)
    got = module.classify(docs, marks)
    parts, held = (3, 1) if kind == "quality" else (5, 0)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    judged = got.where("held_out").join(marks.where(f"{kind} is not null"), "doc_id").collect()
    right = sum(r.predicted == r[kind] for r in judged)
    assert len(judged) > 40 and right >= 0.95 * len(judged)
    none = module.classify(documents(spark), labels(spark, []))
    assert {r.score for r in none.collect()} == {0.5}
    assert module.classify(documents(spark, []), marks).count() == 0


def test_quality_keeps_whole_rows(spark):
    docs, marks = classified(spark, "quality")
    kept = quality.keep_good(docs, marks)
    good = quality.score(docs, quality.train(docs, marks)).where("predicted = 1")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in good.collect())
    assert kept.where(F.col("text") == LONG).count() == good.where("doc_id = 8").count()


def test_toxic_passages_are_spans_of_the_text(spark):
    docs, marks = classified(spark, "toxic")
    model = toxicity.train(docs, marks)
    row = toxicity.passages(documents(spark), model).where("doc_id = 13").first()
    text = dict(TEXTS)[13].encode()
    assert any(b"idiot" in text[p.start : p.end] for p in row.passages)
