"""Registered queries against their SQL, where the tables are there, and the contract's shape."""

import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

from verisift.plans import catalogue, frames

QUERIES, ORACLE_SQL = catalogue.QUERIES | frames.QUERIES, catalogue.ORACLE_SQL | frames.ORACLE_SQL

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
TABLES = "events documents pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else repr(float(x)) if isinstance(x, (float, Decimal)) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_works_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "verisift", tmp_path / "verisift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op')])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "[]"], done.stderr
