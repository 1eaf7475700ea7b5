"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from cinegraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalogue.ORACLE_SQL:
        want = db.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert sorted(map(tuple, entry_module.entry(spark).collect())) == [(0, 1), (1, 15), (2, 112), (3, 71), (4, 1)]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """In a copy without them the queries of the core are registered; what they need may not be missing."""
    root = Path(entry_module.__file__).parent
    shutil.copytree(root / "cinegraph", tmp_path / "cinegraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    check = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not {'op1_secret_scan', 'op10_quality_rules', 'pipeline'} & set(e.queries())"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    (tmp_path / "cinegraph" / "llm").mkdir()
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    (tmp_path / "cinegraph" / "llm" / "queries.py").write_text("import a_library_that_is_not_there")
    assert subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, stderr=subprocess.DEVNULL).returncode
