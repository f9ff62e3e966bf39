"""The given tables seen as catalogue tables; each has its SQL as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.lower("p_type").alias("category"), F.col("p_retailprice").cast("bigint").alias("price"), (F.col("p_size") / 4.0).alias("usd"),
    )


PRODUCTS = """products AS (SELECT 'p' || p_partkey AS id, p_partkey AS ord, p_name AS name, p_brand AS brand, lower(p_type) AS category,
    CAST(floor(p_retailprice) AS BIGINT) AS price, p_size / 4.0 AS usd FROM part)"""


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Product by source, from all lines."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("source")).distinct()


OFFERS = "offers AS (SELECT DISTINCT 'p' || l_partkey AS id, 's' || (l_suppkey % 10) AS source FROM lineitem)"


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Region and nation as a coded tree with segments of three; nation 7 has no name."""
    r = table(spark, d, "region").select(F.lit("tpch").alias("site"), F.lpad(F.col("r_regionkey").cast("string"), 3, "0").alias("code"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(
        F.lit("tpch").alias("site"), F.concat(F.lpad(F.col("n_regionkey").cast("string"), 3, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("code"),
        F.when(F.col("n_nationkey") == 7, F.lit("")).otherwise(F.col("n_name")).alias("name"),
    )
    m = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = m.select(F.lit("tpch").alias("site"), F.concat(F.lpad(F.col("n_regionkey").cast("string"), 3, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.rpad(F.substring("c_mktsegment", 1, 3), 3, "x")).alias("code"), F.col("c_mktsegment").alias("name"))
    return r.unionByName(n).unionByName(m)


CODES = """codes AS (SELECT 'tpch' AS site, lpad(CAST(r_regionkey AS VARCHAR), 3, '0') AS code, r_name AS name FROM region
    UNION ALL SELECT 'tpch', lpad(CAST(n_regionkey AS VARCHAR), 3, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), CASE WHEN n_nationkey = 7 THEN '' ELSE n_name END FROM nation
    UNION ALL SELECT DISTINCT 'tpch', lpad(CAST(n_regionkey AS VARCHAR), 3, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || rpad(substr(c_mktsegment, 1, 3), 3, 'x'), c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages: site = host, cat = first part of the path, sid = number of the path."""
    p = table(spark, d, "pages")
    return p.select(
        "page_id", "url", "html", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("site"), F.regexp_extract("url", r"^https?://[^/]+/([^/]+)/", 1).alias("cat"),
        F.regexp_extract("url", r"/([0-9]+)", 1).alias("sid"),
    )


PAGES = r"""pg AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/]+)/', 1) AS site, regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS cat,
    regexp_extract(url, '/([0-9]+)', 1) AS sid FROM pages)"""
