"""The driver's contract."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_corpus_part():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "segmill")):
        for name in names:
            if name.endswith(".py") and "/llm" not in folder:
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read())


def test_order_queries_without_the_corpus_part(tmp_path):
    """On a copy without both folders, with and without the pipeline's file."""
    root, copy = os.path.dirname(os.path.abspath(entry.__file__)), tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__")])
    ask = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    found = []
    for _ in range(2):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        found.append(subprocess.run([sys.executable, "-c", ask], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split())
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert found[0] == found[1] == sorted(n for n in entry.queries() if not re.match(r"op\d|pipeline$", n)) and len(found[0]) > 50


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    key = lambda r: str([plain(v) for v in r])
    assert sorted(map(key, df.select(*[f"`{c}`" for c in columns]).collect())) == sorted(map(key, want))
