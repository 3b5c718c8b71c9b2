import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quarry.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    got = __spark_entry__.queries()[name](spark, SMALL).select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_a_library_that_is_missing_does_not_hide_queries(tmp_path):
    """Only where the corpus operators are there; without them there is nothing to hide."""
    if "pipeline" not in __spark_entry__.queries():
        return
    (tmp_path / "xxhash.py").write_text("raise ImportError('not installed')")
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, check=False)
    assert run.returncode != 0 and "not installed" in run.stderr


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for part in ("quarry", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(root / part) if part.endswith(".py") else None
    (tmp_path / "quarry").mkdir()
    for p in (root / "quarry").iterdir():
        if p.name != "llm":
            (tmp_path / "quarry" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    entry = (root / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
