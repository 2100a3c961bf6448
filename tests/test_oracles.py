"""Every registered retrieval and corpus query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([plain(x) for x in v])
        if pd.isna(v):
            return "~"
        return str(round(float(v), 6)) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, D).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_entry_without_training_operators(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
