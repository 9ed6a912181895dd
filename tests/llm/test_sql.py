"""Queries that SQL can express, against DuckDB over the same tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from tidemark.llm import queries


def rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if pd.isna(v) else float(v) if isinstance(v, numbers.Number) else v
    return sorted(repr([clean(v) for v in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.queries()[name](spark, small).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
