import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandgraph.jobs import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def ordered(rows):
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.execute(entry.oracle_sql()[name]).description]
    assert sorted(got.columns) == sorted(names)
    assert ordered(got.select(*names).collect()) == ordered(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_job_is_checked():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_the_rest_stands_alone(tmp_path):
    root = Path(importlib.import_module("strandgraph").__file__).parent
    (tmp_path / "strandgraph").mkdir()
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            to = tmp_path / "strandgraph" / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((root.parent / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 30; assert not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True)
