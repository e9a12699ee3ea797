"""Registered training-data queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from verisift.llm import catalogue

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if x is None or x != x else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), c.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in catalogue.QUERIES) for n in range(1, 11)] == [1] * 10 and "pipeline" in catalogue.QUERIES
