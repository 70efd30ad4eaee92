"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from querent.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.12g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.sql(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(registry.FIXED))
def test_files_of_no_table(spark, duck, name):
    assert name not in registry.QUERIES
    ours, theirs = registry.FIXED[name](spark, DATA).toPandas(), duck.sql(registry.FIXED_ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE)):
        assert registry.QUERIES[name](spark, DATA).count() > 0, name


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["complexity", "n", "hits", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
