"""Queries of rule sets as large as the data: keywords and brand prefixes made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brand, classify
from .registry import query
from .tables import table

_TITLES = "titles AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_partkey AS title FROM part)"
_KEYWORDS = """kw AS (SELECT split_part(p_name, ' ', 2) || ' ' || lower(p_brand) || ' ' || left(CAST(p_partkey AS VARCHAR), greatest(1, length(CAST(p_partkey AS VARCHAR)) - 1)) AS keyword, min(p_partkey) AS m
    FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1), rules AS (SELECT -m AS priority, 'g' || m % 50 AS out, keyword FROM kw)"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("title"))


def _short(key: Column) -> Column:
    return F.left(key.cast("string"), F.greatest(F.lit(1), F.length(key.cast("string")) - 1))


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    """Rules (priority, out, keyword) from the sold parts: the last word of the name, the brand, and the number without its last digit."""
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().hint("merge")  # a well-packed file of many keys looks small enough to be broadcast
    p = table(spark, d, "part").join(sold, "p_partkey", "left_semi")
    keyword = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_brand"), _short(F.col("p_partkey")))
    found = p.groupBy(keyword.alias("keyword")).agg(F.min("p_partkey").alias("m"))
    return found.select((-F.col("m")).alias("priority"), F.concat(F.lit("g"), (F.col("m") % 50).cast("string")).alias("out"), "keyword")


@query(f"""WITH {_TITLES}, {_KEYWORDS}, h AS (SELECT id, arg_min(out, priority) AS cls, count(*) AS hits FROM titles JOIN rules ON contains(lower(title), keyword) GROUP BY id)
    SELECT titles.id, cls FROM titles LEFT JOIN h ON h.id = titles.id""")
def matched_rules(spark: SparkSession, d: str) -> DataFrame:
    """C1 with some thousand rules, by the gram index."""
    return classify.first_match_join(_titles(spark, d), "title", _keywords(spark, d), "cls").select("id", "cls")


@query(f"""WITH {_TITLES}, {_KEYWORDS}, h AS (SELECT id, priority FROM titles JOIN rules ON contains(lower(title), keyword)), f AS (SELECT id, min(priority) AS first FROM h GROUP BY id)
    SELECT r.priority, count(h.id) AS hits, count(*) FILTER (WHERE f.first = r.priority) AS first_hits FROM rules r LEFT JOIN h ON h.priority = r.priority LEFT JOIN f ON f.id = h.id GROUP BY 1""")
def large_rule_audit(spark: SparkSession, d: str) -> DataFrame:
    found = classify.rule_audit(_titles(spark, d), "title", _keywords(spark, d).select("priority", "keyword"))
    return found.select("priority", F.col("hits").cast("bigint").alias("hits"), F.col("first_hits").cast("bigint").alias("first_hits"))


@query(f"""WITH {_KEYWORDS}, o AS (SELECT -priority AS priority, keyword FROM rules), x AS (SELECT l.priority, l.keyword, min(e.priority) AS earlier FROM o l JOIN o e ON contains(l.keyword, e.keyword) GROUP BY ALL)
    SELECT priority, min(earlier) AS earlier FROM x GROUP BY priority HAVING bool_and(earlier < priority)""")
def dead_rules(spark: SparkSession, d: str) -> DataFrame:
    """C12: rules that can never win, from the rules alone (the small numbers' first)."""
    return classify.dead_rules(_keywords(spark, d).withColumn("priority", -F.col("priority")))


_PREFIXES = """px AS (SELECT left(title, 6 + id % 14) AS prefix, min(id) AS m FROM titles WHERE id % 3 <> 1 GROUP BY 1), rules AS (SELECT -m AS priority, prefix, 'b' || m AS slug FROM px),
    nm AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 7 = 1 THEN replace(title, ' ', '') ELSE title END AS n, CASE WHEN id % 3 = 0 THEN upper(title) END AS tag FROM titles)"""


@query(f"""WITH {_TITLES}, {_PREFIXES}, h AS (SELECT id, arg_min(slug, priority) AS slug FROM nm JOIN rules ON CASE WHEN tag IS NULL THEN starts_with(n, prefix) OR starts_with(replace(n, ' ', ''), replace(prefix, ' ', ''))
        ELSE starts_with(replace(tag, ' ', ''), upper(replace(prefix, ' ', ''))) END GROUP BY id) SELECT nm.id, coalesce(slug, '_misc') AS slug FROM nm LEFT JOIN h ON h.id = nm.id""")
def brand_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """J9 with some thousand brands. Every third name bears its brand in a tag only, and some names have no blanks."""
    t = _titles(spark, d)
    rules = t.where("id % 3 <> 1").groupBy(F.expr("left(title, cast(6 + id % 14 as int))").alias("prefix")).agg(F.min("id").alias("m"))
    rules = rules.select((-F.col("m")).alias("priority"), "prefix", F.concat(F.lit("b"), F.col("m").cast("string")).alias("slug"))
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("[x][") , F.upper("title"), F.lit("]"))).when(F.col("id") % 7 == 1, F.replace("title", F.lit(" "), F.lit(""))).otherwise(F.col("title"))
    return brand.resolve_brands(t.withColumn("name", name), rules).select("id", "slug")
