"""Every registered query of the library against its SQL in DuckDB."""

import numbers

import duckdb
import pandas as pd
import pytest

from tidemark.plans import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def rows(df):
    cols = sorted(df.columns)

    def clean(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, numbers.Number) else str(v)

    return sorted(repr([clean(v) for v in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, con, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() >= 0
