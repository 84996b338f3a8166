"""Every query that has SQL against DuckDB on the smallest tables, and the entry."""

import duckdb
import pytest

import __spark_entry__
from tarifflens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(row):
    return tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) or hasattr(x, "as_tuple") else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((plain(r) for r in found.select(*columns).collect()), key=repr)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == sorted((plain(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
