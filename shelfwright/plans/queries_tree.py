"""Queries of category trees and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, tree
from ..sources import sinks
from .registry import query
from .tables import CODES, codes, table

_ANC = """anc AS (SELECT c.site, c.code, coalesce(array_to_string(list(p.name ORDER BY length(p.code)) FILTER (WHERE p.name <> ''), ' > '), '') AS path
    FROM (SELECT DISTINCT site, code FROM codes) c LEFT JOIN codes p ON p.site = c.site AND starts_with(c.code, p.code) AND length(p.code) % 3 = 0 GROUP BY c.site, c.code)"""


@query(f"WITH {CODES}, {_ANC} SELECT site, code, path FROM anc")
def ancestor_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.ancestor_paths(codes(spark, d), 3).select("site", "code", F.array_join("path", " > ").alias("path"))


@query("""WITH c AS (SELECT 's' AS site, CAST(l_partkey AS VARCHAR) AS code FROM lineitem GROUP BY ALL)
    SELECT a.code, array_to_string(list(b.code ORDER BY length(b.code)), '/') AS path FROM c a JOIN c b ON starts_with(a.code, b.code) GROUP BY a.code""")
def prefix_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """J4: prefixes of any length, on part numbers as codes."""
    c = table(spark, d, "lineitem").select(F.lit("s").alias("site"), F.col("l_partkey").cast("string").alias("code")).distinct().withColumn("name", F.col("code"))
    return tree.ancestor_paths(c, 1).select("code", F.array_join("path", "/").alias("path"))


@query("""WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS code FROM lineitem GROUP BY ALL)
    SELECT code FROM c WHERE NOT regexp_matches(code, '7') AND NOT EXISTS (SELECT 1 FROM c o WHERE o.code <> c.code AND starts_with(o.code, c.code))""")
def leaf_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.lit("s").alias("site"), F.col("l_partkey").cast("string").alias("code")).distinct().withColumn("name", F.col("code"))
    return tree.leaves(c, skip="7").select("code")



@query("""WITH p AS (SELECT DISTINCT p_brand AS a, CASE WHEN p_size > 2 THEN split_part(p_name, ' ', 1) END AS b, CASE WHEN p_size > 4 THEN split_part(p_name, ' ', 2) END AS c FROM part),
    q AS (SELECT concat_ws(' > ', a, b, c) AS path FROM p) SELECT path FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE starts_with(o.path, q.path || ' > '))""")
def leaf_name_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    parts = F.split("p_name", " ")
    path = F.array_compact(F.array("p_brand", F.when(F.col("p_size") > 2, parts[0]), F.when(F.col("p_size") > 4, parts[1])))
    return tree.leaf_paths(p.select(F.lit("s").alias("site"), path.alias("path")).distinct()).select(F.array_join("path", " > ").alias("path"))


@query("""WITH RECURSIVE n AS (SELECT r_regionkey + 1 AS id, r_name AS name, 0 AS parent FROM region UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey + 1 FROM nation
        UNION ALL SELECT 1000 + s_suppkey, s_name, CASE WHEN s_suppkey % 17 = 0 THEN 999999 ELSE 100 + s_nationkey END FROM supplier),
    up AS (SELECT id, name AS path FROM n WHERE parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, up.path || ' > ' || n.name FROM up JOIN n ON n.parent = up.id)
    SELECT CAST(id AS BIGINT) AS id, path FROM up""")
def parent_paths(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation and supplier by parent pointers; every seventeenth supplier's parent is unknown."""
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("id"), F.col("r_name").alias("name"), F.lit(0).cast("bigint").alias("parent"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("bigint").alias("parent"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 17 == 0, F.lit(999999)).otherwise(F.col("s_nationkey") + 100).cast("bigint").alias("parent"))
    return tree.parent_paths(r.unionByName(n).unionByName(s)).select("id", F.array_join("path", " > ").alias("path"))


@query("""SELECT r_name || '' AS code, r_name AS path FROM region WHERE r_regionkey > 0 UNION ALL
    SELECT r_name || '-' || n_nationkey, CASE WHEN r_regionkey > 0 THEN r_name || ' > ' ELSE '' END || n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def two_part_paths(spark: SparkSession, d: str) -> DataFrame:
    """Codes 'x' and 'x-m'; the first region is not in the menu, so its nations have a path of one level."""
    r = table(spark, d, "region")
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nav = r.where("r_regionkey > 0").select(F.lit("s").alias("site"), F.col("r_name").alias("code"), F.col("r_name").alias("name"))
    nav = nav.unionByName(n.select(F.lit("s").alias("site"), F.concat_ws("-", "r_name", F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name")))
    return tree.two_part_paths(nav).select("code", F.array_join("path", " > ").alias("path"))


_LISTED = """ls AS (SELECT 'tpch' AS site, CAST(c_custkey AS VARCHAR) AS sid, code, length(code) // 3 AS depth FROM customer JOIN codes ON starts_with(code, lpad(CAST(c_custkey % 5 AS VARCHAR), 3, '0')) WHERE length(code) <= 3 + 3 * (c_custkey % 3)),
    m AS (SELECT site, sid, code FROM (SELECT *, row_number() OVER (PARTITION BY site, sid ORDER BY depth DESC, code) AS rn FROM ls) WHERE rn = 1)"""


def _membership(spark: SparkSession, d: str) -> DataFrame:
    """Customers as products that several categories of a region list."""
    c = codes(spark, d).select("site", "code", (F.length("code") / 3).cast("int").alias("depth"), F.substring("code", 1, 3).alias("root"))
    p = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sid"), F.lpad((F.col("c_custkey") % 5).cast("string"), 3, "0").alias("root"), (1 + F.col("c_custkey") % 3).alias("most"))
    return tree.deepest_membership(p.join(c, "root").where("depth <= most"))


@query(f"WITH {CODES}, {_LISTED} SELECT site, sid, code FROM m")
def membership(spark: SparkSession, d: str) -> DataFrame:
    return _membership(spark, d)


@query(f"WITH {CODES}, {_LISTED}, {_ANC} SELECT m.site, count(*) AS mapped, count(*) FILTER (WHERE contains(path, ' > ')) AS multi FROM m LEFT JOIN anc ON m.site = anc.site AND m.code = anc.code GROUP BY m.site")
def walk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.walk_coverage(_membership(spark, d), tree.ancestor_paths(codes(spark, d), 3))


def _tree_products(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("tpch").alias("source"), F.when(F.col("c_custkey") % 4 == 0, F.lit("none")).otherwise(F.col("c_custkey").cast("string")).alias("source_id"),
        F.when(F.col("c_custkey") % 8 == 0, F.lit("")).otherwise(F.lpad((F.col("c_custkey") % 6).cast("string"), 3, "0")).alias("cate_no"), F.lower("c_mktsegment").alias("category"), F.array("c_mktsegment").alias("cat_path"),
    )


_REBUILT = f"""WITH {CODES}, {_LISTED}, {_ANC}, pr AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE CAST(c_custkey AS VARCHAR) END AS source_id,
        CASE WHEN c_custkey % 8 = 0 THEN '' ELSE lpad(CAST(c_custkey % 6 AS VARCHAR), 3, '0') END AS cate_no, lower(c_mktsegment) AS category, c_mktsegment AS cat_path FROM customer),
    re AS (SELECT pr.*, coalesce(nullif(a.path, ''), nullif(b.path, '')) AS new FROM pr LEFT JOIN m ON m.sid = pr.source_id LEFT JOIN anc a ON a.code = m.code LEFT JOIN anc b ON b.code = pr.cate_no),
    rb AS (SELECT id, cate_no, coalesce(new, cat_path) AS path, new IS NOT NULL AS path_found, new IS NOT NULL AND new <> cat_path AS path_changed, CASE WHEN new IS NOT NULL AND new <> cat_path THEN split_part(new, ' > ', -1) ELSE category END AS category FROM re)"""


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return tree.rebuild_paths(_tree_products(spark, d), _membership(spark, d), tree.ancestor_paths(codes(spark, d), 3))


@query(_REBUILT + " SELECT id, path, category, path_found, path_changed FROM rb")
def rebuilt_paths(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d).select("id", F.array_join("cat_path", " > ").alias("path"), "category", "path_found", "path_changed")


@query(_REBUILT + " SELECT 'tpch' AS source, count(*) AS n_rows, count(*) FILTER (WHERE path_found) AS restored, count(*) FILTER (WHERE contains(path, ' > ')) AS multi_level FROM rb")
def path_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.path_coverage(_rebuilt(spark, d))


@query(_REBUILT + " SELECT left(id, 3) AS brand_slug, count(*) AS changed FROM rb WHERE path_changed GROUP BY ALL")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    before = _tree_products(spark, d)
    diff = sinks.changed(before, _rebuilt(spark, d), ["id"], ["cat_path"])
    return diff.groupBy(F.substring("id", 1, 3).alias("brand_slug")).agg(F.count("*").alias("changed"))


@query("SELECT 'tpch' AS source, array_to_string(list(DISTINCT lpad(CAST(c_custkey % 6 AS VARCHAR), 3, '0') ORDER BY lpad(CAST(c_custkey % 6 AS VARCHAR), 3, '0')), ',') AS codes FROM customer WHERE c_custkey % 8 <> 0")
def used_codes(spark: SparkSession, d: str) -> DataFrame:
    return tree.used_codes(_tree_products(spark, d)).select("source", F.array_join("codes", ",").alias("codes"))


@query("""WITH p AS (SELECT p_name AS name, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '>' || p_type ELSE p_brand || '>' || p_type || '>' || p_size END AS path, p_size % 3 AS n FROM part)
    SELECT name, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, pos) AS rn FROM p) WHERE rn = 1""")
def deepest_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).when(F.col("p_size") % 3 == 1, F.array("p_brand", "p_type")).otherwise(F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    found = tree.deepest_path(p.select(F.col("p_name").alias("name"), path.alias("path"), F.col("p_partkey").alias("pos")), "name", "path", "pos")
    return found.select("name", F.array_join("path", ">").alias("path"))
