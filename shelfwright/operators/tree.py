"""Category trees: ancestors, leaves, membership, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import present
from ..sources.staging import staging_dir


def prefixes(code: Column, step: int) -> Column:
    """The code's prefixes at multiples of `step`, the shortest first, itself last."""
    return F.when(F.length(code) >= step, F.transform(F.sequence(F.lit(step), F.length(code), F.lit(step)), lambda i: F.substring(code, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def ancestor_paths(codes: DataFrame, step: int = 1, names: DataFrame | None = None) -> DataFrame:
    """J3 (fixed segment width), J4 (step=1: any prefix). (site, code, path) from (site, code, name): names of the code's
    prefixes that are codes, from the root; those without a name are left out. Prefixes are exploded and joined by
    equality, so no pair of codes is compared."""
    names = (names or codes).where(present(F.col("name")).isNotNull()).select("site", F.col("code").alias("_p"), "name")
    steps = codes.select("site", "code").distinct().withColumn("_p", F.explode_outer(prefixes(F.col("code"), step)))
    found = steps.join(names, ["site", "_p"], "left").groupBy("site", "code")
    parts = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct(F.length("_p").alias("n"), "name"))))
    return found.agg(F.transform(parts, lambda x: x["name"]).alias("path"))


def leaves(codes: DataFrame, skip: str | None = None) -> DataFrame:
    """J5. Codes that are no other code's proper prefix. skip (F3): a pattern of names that are left out afterwards."""
    longer = codes.where(F.length("code") > 1).select("site", F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda i: F.substring(F.col("code"), F.lit(1), i))).alias("code")).distinct()
    found = codes.join(longer, ["site", "code"], "left_anti")
    return found.where(~F.coalesce(F.col("name"), F.lit("")).rlike(skip)) if skip else found


def leaf_paths(paths: DataFrame) -> DataFrame:
    """J6. Rows whose name path is not the beginning of a longer one."""
    longer = paths.where(F.size("path") > 1).select("site", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i))).alias("path")).distinct()
    return paths.join(longer, ["site", "path"], "left_anti")


def parent_paths(nodes: DataFrame, root: int = 0) -> DataFrame:
    """J7. (id, path) by parent pointers: rows (id, name, parent), `root` or an unknown id as parent ends a path. Nodes on a cycle, and
    those below one, have no path: null.

    Each round joins every open path with that of the node it hangs on, so paths double and the rounds are the logarithm of the
    depth. Rounds are written tables.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col("id").alias("up")).distinct()
    state = nodes.join(known, (F.col("parent") == F.col("up")) & (F.col("parent") != root), "left").select("id", F.array("name").alias("path"), "up")
    left = None
    while True:
        path = staging_dir(spark)
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        open_ = state.where("up is not null").count()
        if not open_ or open_ == left:
            return state.select("id", F.when(F.col("up").isNull(), F.col("path")).alias("path"))
        left = open_
        above = state.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        state = state.join(above, F.col("up") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"), F.col("_up").alias("up"))


def two_part_paths(nav: DataFrame) -> DataFrame:
    """J8. (site, code, path) of codes 'x' and 'x-m': the parent by the first part, left out where it has no name."""
    tops = nav.where(~F.contains("code", F.lit("-"))).select("site", F.col("code").alias("_x"), F.col("name").alias("_top"))
    rows = nav.withColumn("_x", F.split_part("code", F.lit("-"), F.lit(1))).join(tops, ["site", "_x"], "left")
    path = F.when(F.contains("code", F.lit("-")), F.array_compact(F.array(present(F.col("_top")), present(F.col("name"))))).otherwise(F.array("name"))
    return rows.select("site", "code", path.alias("path"))


def deepest_membership(listed: DataFrame, depth: str = "depth") -> DataFrame:
    """W3. (site, sid, code): of the leaves that list a product, the deepest, then the smallest code."""
    best = Window.partitionBy("site", "sid").orderBy(F.desc(depth), "code")
    return listed.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("site", "sid", "code")


def deepest_path(products: DataFrame, key: str, path: str, pos: str) -> DataFrame:
    """A16. Each product's deepest path; of equals the first."""
    return products.groupBy(key).agg(F.max_by(path, F.struct(F.size(path), -F.col(pos))).alias("path"))


def rebuild_paths(products: DataFrame, membership: DataFrame, paths: DataFrame, append_source: str | None = None) -> DataFrame:
    """J2, M2. cat_path from the walk's membership code, else from the product's own cate_no; category is its last level.

    Products without a path stay as they are; `append_source` adds its stored category as the last level. Adds
    `path_found` and `path_changed`.
    """
    m = membership.select(F.col("site").alias("source"), F.col("sid").alias("source_id"), F.col("code").alias("_code"))
    p = paths.select(F.col("site").alias("source"), F.col("code").alias("_code"), F.col("path").alias("_path"))
    q = p.select("source", F.col("_code").alias("cate_no"), F.col("_path").alias("_own"))
    out = products.join(m, ["source", "source_id"], "left").join(p, ["source", "_code"], "left").join(q, ["source", "cate_no"], "left")
    found = F.when(F.size("_path") > 0, F.col("_path")).when(F.size("_own") > 0, F.col("_own"))
    if append_source:
        found = F.when((F.col("source") == append_source) & present(F.col("category")).isNotNull(), F.when(F.element_at(found, -1) == F.col("category"), found).otherwise(F.array_append(found, F.col("category")))).otherwise(found)
    out = out.withColumn("_new", found)
    same = F.col("_new").eqNullSafe(F.col("cat_path"))
    return (
        out.withColumn("path_found", F.col("_new").isNotNull()).withColumn("path_changed", F.col("_new").isNotNull() & ~same)
        .withColumn("category", F.when(F.col("path_changed"), F.element_at("_new", -1)).otherwise(F.col("category"))).withColumn("cat_path", F.coalesce("_new", "cat_path"))
        .select(*products.columns, "path_found", "path_changed")
    )


def used_codes(products: DataFrame) -> DataFrame:
    """A18. (source, codes): category codes in use, empty ones left out, sorted."""
    return products.where(present(F.col("cate_no")).isNotNull()).groupBy("source").agg(F.array_sort(F.collect_set("cate_no")).alias("codes"))
