"""Queries on tables like large ones: numbers that look like years, ids that repeat, places that tie, tables in folders."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import SF, TABLES, plain

from tarifflens.operators import layout, ledger
from tarifflens.plans import registry

#: Suppliers get numbers from 1900 on and parts from 12000000 on; of some items, another of the same id is there.
MADE = {
    "supplier": "SELECT * REPLACE (s_suppkey + 1900 AS s_suppkey) FROM {t}",
    "part": "SELECT * REPLACE (p_partkey + 12000000 AS p_partkey) FROM {t} UNION ALL SELECT * REPLACE (p_partkey + 12001000 AS p_partkey, p_name || ' b' AS p_name) FROM {t}",
    "lineitem": """WITH l AS (SELECT * REPLACE (l_suppkey + 1900 AS l_suppkey, l_partkey + 12000000 AS l_partkey) FROM {t})
        SELECT * FROM l UNION ALL SELECT * REPLACE (l_partkey + 1000 AS l_partkey, l_extendedprice * 2 AS l_extendedprice, l_shipdate + INTERVAL 40 DAY AS l_shipdate) FROM l WHERE l_orderkey % 10 = 3
        UNION ALL SELECT * REPLACE (l_suppkey + 1000 AS l_suppkey, l_extendedprice * 3 AS l_extendedprice) FROM l WHERE l_orderkey % 10 = 4""",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    out, con = tmp_path_factory.mktemp("larger"), duckdb.connect()
    for name in TABLES:
        (out / f"{name}.parquet").mkdir()
        sql = MADE.get(name, "SELECT * FROM {t}").format(t=f"'{SF}/{name}.parquet'")
        con.sql(f"COPY ({sql}) TO '{out}/{name}.parquet/part-0.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet/*.parquet'")
    return str(out), con


@pytest.mark.parametrize("name", ["apply_match", "apply_review", "ledger_documents", "ledger_items", "ledger_services", "partner_name", "previous_price", "price_anomaly", "price_values", "review_drafts", "src_directory"])
def test_query(spark, tables, name):
    folder, duck = tables
    found = registry.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    rows = sorted((plain(r) for r in found.select(*columns).collect()), key=repr)
    want = duck.sql(registry.ORACLES[name])
    assert rows == sorted((plain(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_archive_deleted_often(spark):
    """Many events that delete one archive aren't multiplied by its documents."""
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("archive"))
    gone = spark.range(2_000).select(F.col("id").alias("seq"), F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("archive"))
    found = ledger._deleted(docs, gone).collect()
    assert len(found) == 2_000 and {r["seq"] for r in found} == {0}


def test_ties_by_a_column(spark):
    rows = [(1, 0, 5.0, 7.0, t, n) for n, t in enumerate(["b", "a", "a"])]
    for order in (rows, rows[::-1]):
        words = spark.createDataFrame(order, "doc_id long, page int, x0 double, y0 double, text string, event_id long").coalesce(1)
        assert layout.block_rows(words, ties=("event_id",)).first()["row_text"] == "b | a | a"
        lines = layout.line_rows(words, ties=("event_id",)).collect()
        assert {r["event_id"]: r["row_idx"] for r in lines} == {0: 2, 1: 0, 2: 1}


@pytest.mark.parametrize("name, keys", [("block_rows", "x0, y0"), ("line_rows", "y0, x0, text")])
def test_words_that_tie_are_in_an_order_that_the_sql_allows(spark, tmp_path, name, keys):
    """Every word stands at the place of three others. With event_id behind the SQL's keys, no tie is open and nothing differs."""
    copies = f"SELECT e.* REPLACE (event_id + k * 3 * 499 * 211 AS event_id) FROM '{SF}/events.parquet' e, (SELECT unnest(range(4)) AS k)"
    con = duckdb.connect()
    con.sql(f"COPY ({copies}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = registry.QUERIES[name](spark, str(tmp_path))
    want = con.sql(registry.ORACLES[name].replace(f"ORDER BY {keys})", f"ORDER BY {keys}, event_id)"))
    rows = found.select(*want.columns).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(want.fetchall())
