import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from strandgraph.llm import pii, quality, tokens
from tests.llm.test_text_operators import brute_components, brute_hits, near_copies, sets_of


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(9)
    item = " ".join(f"bench{i}" for i in range(14))
    rows = near_copies(4, families=4, size=6)
    rows += [(1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(60)) + (f" mail me{i}@x.org" if i % 5 == 0 else "") + (" " + item if i % 7 == 0 else "")) for i in range(80)]
    rows += [(2000 + i, " ".join(f"j{r.randrange(10**6)}***" for _ in range(50))) for i in range(40)]
    marks = [(i, int(i < 2000), 0) for i, _ in rows]
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(t) for _, t in rows]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [m[0] for m in marks], "quality": pa.array([m[1] for m in marks], pa.int32()), "toxic": pa.array([m[2] for m in marks], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [5], "text": [item]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert not any(i >= 2000 for i in kept) and all(i in kept for i, _ in rows if i < 2000)
    rest = [(i, t) for i, t in rows if i in kept]
    comp = brute_components(sets_of(rest))
    rest = [(i, t) for i, t in rest if comp[i] == i and not brute_hits(t, [(5, item)])[4]]
    memo = tokens.memo(tokens.vocabulary_path())
    field = pii.learn(spark.createDataFrame(rest, "doc_id long, text string"))
    want = {i: len(memo.ids(pii.redacted(t, field))) // 2 + 1 for i, t in rest}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.doc_tokens for x in got} == want
    assert sum(x.length for x in got) == sum(want.values())
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def written(folder, rows, marks, items):
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": pa.array(["en"] * len(rows), pa.string()), "source": pa.array(["s"] * len(rows), pa.string()), "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([m[0] for m in marks], pa.int64()), "quality": pa.array([m[1] for m in marks], pa.int32()), "toxic": pa.array([None] * len(marks), pa.int32()), "text": pa.array(["x"] * len(marks), pa.string()), "label": pa.array([9] * len(marks), pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "doc_id": pa.array([0] * len(items), pa.int64())}), folder / "benchmark.parquet")
    return str(folder)


def test_pipeline_of_nulls_repeats_and_nothing(spark, tmp_path):
    (tmp_path / "odd").mkdir()
    (tmp_path / "none").mkdir()
    item = " ".join(f"bench{i}" for i in range(12))
    text = " ".join(f"plain{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " more"), (2, "another text of the same id with me@x.org in it"), (3, None), (3, None), (4, ""), (None, text), (None, "a row without an id"), (5, "before " + item + " after")]
    got = corpus_pipeline.run(spark, written(tmp_path / "odd", rows, [], [(1, item), (None, "a row"), (2, None)])).collect()
    memo = tokens.memo(tokens.vocabulary_path())
    kept = [(1, text), (2, "another text of the same id with <email> in it"), (3, None), (4, ""), (None, "a row without an id")]
    assert sorted((str(x.doc_id), x.doc_tokens) for x in got) == sorted((str(i), len(memo.ids(t)) // 2 + 1) for i, t in kept)
    assert corpus_pipeline.run(spark, written(tmp_path / "none", [], [], [])).count() == 0


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        docs = out
