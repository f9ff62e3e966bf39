"""Queries of results that are kept up to date from changes, or looked up in stored files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, maintained
from ..sources.staging import staged, staging_dir
from . import demo_rules as R
from .queries_catalog import _CARDS, _DISPLAY, _ORDER, cards, shown
from .registry import query
from .tables import OFFERS, PRODUCTS, offers, products, table

_LEVELS = "SELECT CAST(CASE grouping_id(c, s, sub) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS level, c AS category, s AS brand, sub, count(*) AS n FROM cards GROUP BY GROUPING SETS ((), (c), (c, s), (c, s, sub))"


@query(f"WITH {_CARDS} {_LEVELS}")
def maintained_facets(spark: SparkSession, d: str) -> DataFrame:
    """A5-A9 after ten batches of changes: each adds some cards in a first form (another sub category, some in another brand) and brings those of
    the batch before into their final one; some cards come and go."""
    path = staging_dir(spark)
    final = staged(cards(spark, d).select("id", "c", "s", "sub", (F.col("ord") % 9).alias("k")))
    first = final.withColumn("sub", F.lit("new")).withColumn("s", F.when(F.col("k") % 2 == 0, F.lit("_misc")).otherwise(F.col("s")))
    gone = final.withColumn("id", F.concat("id", F.lit("-gone"))).withColumn("c", F.lit("t7"))
    state = lambda n: first.where(F.col("k") == n).unionByName(final.where(F.col("k") < n)).unionByName(gone.where((F.col("k") == n) & F.endswith("id", F.lit("1-gone"))))
    for n in range(10):
        before, after = (state(k) if k >= 0 else final.limit(0) for k in (n - 1, n))
        changes = maintained.signed(before, after, ["id"], ["c", "s", "sub"])
        maintained.apply_deltas(spark, path, maintained.facet_deltas(changes), n)
    return maintained.counts(spark, path).withColumn("level", F.col("level").cast("bigint"))


@query(f"WITH {_CARDS} SELECT c, count(DISTINCT id) AS brands, true AS within FROM cards GROUP BY c")
def sketched_brands(spark: SparkSession, d: str) -> DataFrame:
    """A6 from the merged sketches of ten batches that overlap, held against the exact count (cards stand for brands, so that there are many)."""
    c = staged(cards(spark, d).select("c", "id", "ord"))
    batches = reduce(DataFrame.unionByName, [maintained.brand_sketches(c.where((F.col("ord") % 10 == k) | (F.col("ord") % 7 == k)), "c", "id") for k in range(10)])
    told = maintained.sketched_counts(maintained.merged_sketches(staged(batches)))
    exact = catalog.brands_per_category(c, "c", "id").select("c", F.col("brands").alias("exact"))
    return exact.join(told, "c").select("c", F.col("exact").alias("brands"), (F.abs(F.col("brands") - F.col("exact")) <= F.col("error")).alias("within"))


@query(f"""WITH {_CARDS}, {_DISPLAY}, w AS (SELECT cards.*, b FROM cards JOIN disp ON disp.s = cards.s), x AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_ORDER}) AS pos, lag(sub) OVER (PARTITION BY c ORDER BY {_ORDER}) AS before, count(*) OVER (PARTITION BY c) AS total FROM w)
    SELECT c, id, pos, (pos - 1) // 60 AS page, total - pos AS remaining, before IS DISTINCT FROM sub OR pos = 1 AS header FROM x WHERE (c, (pos - 1) // 60) IN (('t2', 0), ('t2', 2), ('t3', 1))""")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of the stored feed, each from the files that hold it."""
    path = staging_dir(spark)
    maintained.write_pages(shown(spark, d), ["c"], catalog.catalogue_order(R.TOP_ORDER), "sub", path)
    rows = reduce(DataFrame.unionByName, [maintained.read_page(spark, path, {"c": c}, page) for c, page in (("t2", 0), ("t2", 2), ("t3", 1))])
    return rows.select("c", "id", F.col("pos").cast("bigint").alias("pos"), F.col("page").cast("bigint").alias("page"), "remaining", "header")


@query(f"WITH {PRODUCTS} SELECT id, CASE WHEN ord % 97 = 5 THEN 'changed' ELSE name END AS name FROM products WHERE ord % 97 IN (5, 6)")
def digest_changes(spark: SparkSession, d: str) -> DataFrame:
    """K8, M2 by digests: some products have another name, some are new, some have gone."""
    path = staging_dir(spark)
    p = products(spark, d).select("id", "name", "ord")
    before = p.where("ord % 97 <> 6")
    after = p.where("ord % 97 <> 7").withColumn("name", F.when(F.col("ord") % 97 == 5, F.lit("changed")).otherwise(F.col("name")))
    for df, name in ((before, "old"), (after, "new")):
        maintained.write_digested(df.drop("ord"), ["id"], ["name"], f"{path}/{name}", 64, 8)
    return maintained.changed_rows(spark, f"{path}/old", f"{path}/new", ["id"], ["name"])


@query(f"WITH {OFFERS} SELECT o.id, o.source FROM offers o WHERE CAST(substr(o.id, 2) AS INT) % 50 = 3 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE 'p' || l_partkey = o.id AND 's' || (l_suppkey % 10) = o.source AND l_quantity > 25)")
def unstored_offers(spark: SparkSession, d: str) -> DataFrame:
    """J12, J13 with few items and many stored keys."""
    keys = [F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("source")]
    some = offers(spark, d).where(F.expr("cast(substring(id, 2) as int) % 50 = 3"))
    return maintained.without_stored(some, table(spark, d, "lineitem").where("l_quantity > 25").select(*keys), ["id", "source"])
