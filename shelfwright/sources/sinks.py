"""Sinks: versioned brand packs, feed, documents, registry, walks, checkpoints, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import present


def upsert(existing: DataFrame, batch: DataFrame, header_policy: str = "new", sequence: str | None = None) -> DataFrame:
    """K1, K2, T6. Records of the batch replace those of the same (brand_slug, id); the others stay.

    Within one side the last by `sequence` counts, and with it an older record that comes late is refused. The
    pack's brand text is the batch's first (by id) where the slug is in the batch, or with header_policy='old' the
    existing one where there is one.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    order = ([F.desc(sequence)] if sequence else []) + [F.desc("_batch"), F.desc("id")]
    best = Window.partitionBy("brand_slug", "id").orderBy(*order)
    kept = both.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    first = lambda flag: F.min_by(F.when(F.col("_batch") == flag, present(F.col("brand"))), F.when((F.col("_batch") == flag) & present(F.col("brand")).isNotNull(), F.col("id")))
    heads = both.groupBy("brand_slug").agg(first(0).alias("_old"), first(1).alias("_new"))
    head = F.coalesce("_old", "_new") if header_policy == "old" else F.coalesce("_new", "_old")
    return kept.join(heads.select("brand_slug", head.alias("pack_brand_text")), "brand_slug").drop("_batch")


def write_packs(products: DataFrame, path: str) -> None:
    """K1. Only the slugs in `products` are rewritten. `path` must not be read in the same job: write a new version, or save
    what is read first."""
    products.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("brand_slug").parquet(path)


def feed_rows(cards: DataFrame, order: list) -> DataFrame:
    """K3. Compact JSON rows in order."""
    fields = [c for c in ("n", "b", "s", "id", "c", "sub", "p", "usd", "t") if c in cards.columns]
    return cards.orderBy(*order).select(F.to_json(F.struct(*fields)).alias("value"))


def write_feed(cards: DataFrame, path: str, order: list) -> None:
    feed_rows(cards, order).write.mode("overwrite").text(path)


def write_product_docs(docs: DataFrame, path: str, limit: int | None = None) -> None:
    """K4, O6. One document a product, in folders by slug; a sample build writes `limit` of them."""
    (docs.limit(limit) if limit else docs).write.mode("overwrite").partitionBy("brand_slug").json(path)


def registry_rows(brands: DataFrame) -> DataFrame:
    """K5. The registry in its order, with the total on each row."""
    total = brands.agg(F.count("*").alias("total"))
    return brands.join(F.broadcast(total)).orderBy(F.desc("count"), "slug")


def walk_maps(membership: DataFrame, paths: DataFrame, entries: int = 50_000) -> DataFrame:
    """K6. Maps of membership and paths as walk files have them: (site, part, membership, paths). A site of more than about `entries` rows
    is written in parts, dealt out by a hash, so that no map grows with the site; a reader takes them together."""

    def parts(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        sizes = rows.groupBy("site").agg(F.ceil(F.count("*") / entries).alias("_parts"))
        dealt = rows.join(sizes, "site").withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")))
        return dealt.groupBy("site", "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))

    return parts(membership, "sid", "code", "membership").join(parts(paths, "code", "path", "paths"), ["site", "part"], "full_outer")


def write_checkpoint(keys: DataFrame, path: str) -> None:
    """K7. Sorted distinct keys, appended."""
    keys.distinct().sortWithinPartitions(*keys.columns).write.mode("append").json(path)


def changed(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """K8. Rows of `after` that differ from `before` in one of the columns."""
    old = before.select(*key, F.struct(*columns).alias("_old"))
    same = after.join(old, key, "left")
    return same.where(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")


def apply_changes(before: DataFrame, after: DataFrame, key: list[str], columns: list[str], path: str, apply: bool) -> DataFrame:
    """K8. A report of changed rows per slug; with apply=True the changed slugs are written, all their rows with them."""
    diff = changed(before, after, key, columns)
    if apply:
        write_packs(after.join(diff.select("brand_slug").distinct(), "brand_slug", "left_semi"), path)
    return diff.groupBy("brand_slug").agg(F.count("*").alias("changed"))


def archive_removed(products: DataFrame, reason: str, deleted_at: str, path: str) -> None:
    """K9. Removed rows, appended to an archive with the reason."""
    rows = products.select(F.lit(deleted_at).alias("deleted_at"), F.lit(reason).alias("reason"), F.col("id").alias("pid"), "name", "source", "cat_path")
    rows.write.mode("append").json(path)
