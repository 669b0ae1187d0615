"""Every registered query with SQL against DuckDB at the smallest scale."""

import duckdb
import pytest
from pathloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(map(tuple, rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert got == want and got


def test_entry_without_optional_parts(spark, sf):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
