"""The domain's tables, made from the general test tables; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The same tables in DuckDB, to stand in front of a query.
SQL = """WITH partners AS (
    SELECT s_suppkey AS partner_id, s_name AS name, n_name AS city, s_acctbal > 0 AS is_active FROM supplier JOIN nation ON s_nationkey = n_nationkey),
services AS (
    SELECT min(p_partkey) AS service_id, p_name AS service_name, min(p_type) AS category, min(p_brand) || ' ' || p_name AS synonym, min(p_partkey) % 7 <> 0 AS is_active FROM part GROUP BY p_name),
lines AS (
    SELECT *, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS m FROM lineitem),
items AS (
    SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000 * 1000 + l_suppkey % 1000 AS item_id, l_suppkey * 1000 + m AS doc_id, l_suppkey AS partner_id, p_name AS service_name_raw,
           CASE WHEN l_linenumber <> 7 THEN service_id END AS service_id, l_extendedprice AS price_resident,
           CASE WHEN l_linenumber = 6 THEN NULL WHEN l_tax < 0.02 THEN l_extendedprice - 1 ELSE l_extendedprice + 5 END AS price_nonresident,
           CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'R' THEN 'RUB' ELSE 'KZT' END AS currency, l_quantity > 45 AS is_verified,
           CASE WHEN l_discount >= 0.1 THEN 'anomaly: price changed by 60% from previous version' END AS verification_note,
           CASE WHEN (l_suppkey * 1000 + m) % 11 <> 0 THEN CAST(date_trunc('month', l_shipdate) AS date) END AS effective_date,
           l_linestatus = 'F' AS is_active, (l_suppkey * 1000 + m) * 7919 % 100003 AS doc_seq
    FROM lines JOIN part ON l_partkey = p_partkey JOIN services ON p_name = service_name),
docs AS (
    SELECT DISTINCT doc_id, partner_id, partner_id % 25 AS archive_id, effective_date, doc_seq,
           'price_' || partner_id || '_' || (1990 + (doc_id % 1000 - 1) // 12) || CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.XLSX' ELSE '.pdf' END AS file_name,
           CASE doc_id % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'error' ELSE 'processed' END AS parse_status
    FROM items),
archives AS (
    SELECT o_custkey AS archive_id, max(o_orderdate) AS uploaded_at, count(*) AS orders FROM orders GROUP BY o_custkey)
"""


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def partners(spark: SparkSession, d: str) -> DataFrame:
    s, n = _table(spark, d, "supplier"), _table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), (F.col("s_acctbal") > 0).alias("is_active"))


def services(spark: SparkSession, d: str) -> DataFrame:
    g = _table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("service_id"), F.min("p_type").alias("category"), F.min("p_brand").alias("b"))
    return g.select("service_id", F.col("p_name").alias("service_name"), "category", F.array(F.concat_ws(" ", "b", "p_name")).alias("synonyms"), (F.col("service_id") % 7 != 0).alias("is_active"))


def items(spark: SparkSession, d: str) -> DataFrame:
    part, known = _table(spark, d, "part").select("p_partkey", "p_name"), services(spark, d).select("service_name", "service_id")
    li = _table(spark, d, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    li = li.withColumn("doc_id", F.col("l_suppkey") * 1000 + (F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate"))
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).join(known, F.col("p_name") == F.col("service_name"))
    price = F.col("l_extendedprice")
    return rows.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey") % 1000 * 1000 + F.col("l_suppkey") % 1000).alias("item_id"), "doc_id", F.col("l_suppkey").alias("partner_id"), F.col("p_name").alias("service_name_raw"),
        F.when(F.col("l_linenumber") != 7, F.col("service_id")).alias("service_id"), price.alias("price_resident"),
        F.when(F.col("l_linenumber") == 6, F.lit(None)).when(F.col("l_tax") < 0.02, price - 1).otherwise(price + 5).alias("price_nonresident"),
        F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "R", "RUB").otherwise("KZT").alias("currency"), (F.col("l_quantity") > 45).alias("is_verified"),
        F.when(F.col("l_discount") >= 0.1, "anomaly: price changed by 60% from previous version").alias("verification_note"),
        F.when(F.col("doc_id") % 11 != 0, F.trunc("l_shipdate", "month")).alias("effective_date"), (F.col("l_linestatus") == "F").alias("is_active"),
        (F.col("doc_id") * 7919 % 100003).alias("doc_seq"),
    )


def items_apart(spark: SparkSession, d: str) -> DataFrame:
    """items with item_id a pair (item_id, copy): large tables hold several items of one id, each of which has events of its own."""
    rows = items(spark, d)
    order = [c for c in rows.columns if c != "item_id"]
    return rows.withColumn("item_id", F.struct("item_id", F.row_number().over(W.partitionBy("item_id").orderBy(*order)).alias("copy")))


def documents(spark: SparkSession, d: str) -> DataFrame:
    year = (1990 + F.floor((F.col("doc_id") % 1000 - 1) / 12)).cast("string")
    ending = F.when(F.col("doc_id") % 3 == 0, ".docx").when(F.col("doc_id") % 3 == 1, ".XLSX").otherwise(".pdf")
    li = _table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("s"))
    li = li.select(F.col("l_suppkey").alias("partner_id"), F.trunc("s", "month").alias("month"), (F.col("l_suppkey") * 1000 + (F.year("s") - 1990) * 12 + F.month("s")).alias("doc_id")).distinct()
    return li.select(
        "doc_id", "partner_id", (F.col("partner_id") % 25).alias("archive_id"), F.when(F.col("doc_id") % 11 != 0, F.col("month")).alias("effective_date"),
        (F.col("doc_id") * 7919 % 100003).alias("doc_seq"), F.concat(F.lit("price_"), F.col("partner_id").cast("string"), F.lit("_"), year, ending).alias("file_name"),
        F.when(F.col("doc_id") % 5 == 0, "needs_review").when(F.col("doc_id") % 5 == 1, "error").otherwise("processed").alias("parse_status"),
    )


def archives(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("archive_id")).agg(F.max("o_orderdate").alias("uploaded_at"), F.count("*").alias("orders"))


#: Words on pages, and cells of price lists, in SQL that both engines read.
WORDS_SQL = "SELECT user_id AS doc_id, CAST(event_id % 3 AS int) AS page, event_type AS text, CAST((event_id * 53) % 499 AS double) AS x0, CAST((event_id * 37) % 211 AS double) AS y0, CAST((event_id * 53) % 499 + 10 + event_id % 30 AS double) AS x1, event_id FROM events"
CELLS_SQL = """SELECT CAST(p_size AS bigint) AS doc_id, p_partkey AS row_idx, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS int) AS row_no,
    CASE p_partkey % 8 WHEN 0 THEN 'U' || (p_partkey % 40) || '.' || p_size WHEN 1 THEN 'Раздел ' || p_size WHEN 2 THEN '01.' || p_size || ' Консультация'
      WHEN 3 THEN 'Код' WHEN 4 THEN '' WHEN 5 THEN 'КК' || p_size || '.2' WHEN 6 THEN 'KRS.10' ELSE p_brand END AS c0,
    CASE p_partkey % 8 WHEN 3 THEN 'Наименование услуги' WHEN 1 THEN '' ELSE p_name || ' ' || lower(p_type) END AS c1,
    CASE p_partkey % 8 WHEN 3 THEN 'Цена' WHEN 1 THEN '' WHEN 5 THEN CAST(p_partkey AS varchar(20)) || ' 600 тенге' WHEN 6 THEN '$20' WHEN 7 THEN '100 евро' ELSE CAST(p_partkey AS varchar(20)) || ',50' END AS c2
  FROM part"""


def words(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(WORDS_SQL.replace("FROM events", "FROM {t}"), t=_table(spark, d, "events"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CELLS_SQL.replace("FROM part", "FROM {t}"), t=_table(spark, d, "part"))
