"""Repair and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import write_packs
from ..functions.text import present, rekey_url


def promote_thumbs(products: DataFrame) -> DataFrame:
    """M1. Without thumbnail and main image but with detail images: the first of those becomes both. Adds `promoted`."""
    images = F.col("images")
    empty = (F.coalesce(images["thumb"], F.lit("")) == "") & (F.coalesce(F.size(images["main"]), F.lit(0)) <= 0) & (F.size(images["detail"]) > 0)
    first = F.try_element_at(images["detail"], F.lit(1))
    flagged = products.withColumn("promoted", F.coalesce(empty, F.lit(False)))
    return flagged.withColumn("images", F.when(F.col("promoted"), images.withField("thumb", first).withField("main", F.array(first))).otherwise(images))


def image_plan(products: DataFrame, widths: tuple[int, int, int] = (600, 1600, 1400), stored: DataFrame | None = None) -> DataFrame:
    """M3, W9, J13. (id, kind, n, src, key, max_width) of every image to store; keys that are stored already are left out."""
    pick = lambda kind, xs, w, name: F.transform(xs, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("n"), x.alias("src"), name(i + 1).alias("name"), F.lit(w).alias("max_width")))
    none = F.array().cast("array<string>")
    images = F.col("images")
    thumb = F.when(present(images["thumb"]).isNotNull(), F.array(images["thumb"])).otherwise(none)
    rows = F.concat(
        pick("thumb", thumb, widths[0], lambda i: F.lit("thumb")), pick("main", F.coalesce(images["main"], none), widths[1], lambda i: F.concat(F.lit("main"), i.cast("string"))),
        pick("detail", F.coalesce(images["detail"], none), widths[2], lambda i: F.concat(F.lit("detail"), F.lpad(i.cast("string"), 2, "0"))),
    )
    plan = products.select("brand_slug", "id", F.explode(rows).alias("x"))
    plan = plan.select("id", "x.kind", "x.n", "x.src", F.concat_ws("/", F.lit("products"), "brand_slug", "id", F.concat(F.col("x.name"), F.lit(".webp"))).alias("key"), "x.max_width")
    return plan.join(stored.select("key"), "key", "left_anti") if stored is not None else plan


def path_coverage(products: DataFrame, source: str = "source") -> DataFrame:
    """A10. Rows, rows with a restored path, rows with more than one level, of each source."""
    return products.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_if(F.col("path_found")).alias("restored"), F.count_if(F.size("cat_path") > 1).alias("multi_level"))


def thumb_report(products: DataFrame, source: str = "source") -> DataFrame:
    """A11. Promoted rows and rows still without thumbnail, of each source."""
    return products.groupBy(source).agg(F.count_if("promoted").alias("fixed"), F.count_if(F.coalesce(F.col("images.thumb"), F.lit("")) == "").alias("missing"))


def batch_totals(products: DataFrame, brand: str) -> DataFrame:
    """A12. Rows of each brand in a batch, most first."""
    return products.groupBy(brand).agg(F.count("*").alias("n")).orderBy(F.desc("n"), brand)


def catch_all_share(products: DataFrame, code: str, other: list[str]) -> DataFrame:
    """A13. Share of products in the 'other' classes."""
    return products.agg(F.count("*").alias("n"), F.count_if(F.col(code).isin(*other)).alias("n_other"), F.avg(F.col(code).isin(*other).cast("double")).alias("share"))


def walk_coverage(membership: DataFrame, paths: DataFrame) -> DataFrame:
    """A14. Mapped products and those with more than one level, of each walk."""
    joined = membership.join(paths, ["site", "code"], "left")
    return joined.groupBy("site").agg(F.count("*").alias("mapped"), F.count_if(F.size("path") > 1).alias("multi"))


def reclassify(products: DataFrame, resolved: DataFrame, unknown: str = "_misc") -> tuple[DataFrame, DataFrame]:
    """C11, M4, A15. Products of the unknown bucket whose brand is known by now (`resolved`: id, slug) move to it, their media URLs with
    them; the rest stays. Returns all products, and counts of moved and kept."""
    new = resolved.select("id", F.col("slug").alias("_slug"))
    old = F.col("brand_slug")
    moves = (old == unknown) & F.col("_slug").isNotNull() & (F.col("_slug") != unknown)
    rows = products.join(new, "id", "left").withColumn("moved", F.coalesce(moves, F.lit(False)))
    swap = lambda u: rekey_url(u, F.lit(unknown), F.col("_slug"))
    images = F.col("images")
    moved_images = images.withField("thumb", swap(images["thumb"])).withField("main", F.transform(images["main"], swap)).withField("detail", F.transform(images["detail"], swap))
    rows = rows.withColumn("images", F.when(F.col("moved"), moved_images).otherwise(images)).withColumn("brand_slug", F.when(F.col("moved"), F.col("_slug")).otherwise(old)).drop("_slug")
    report = rows.where(F.col("moved") | (F.col("brand_slug") == unknown)).groupBy("moved").agg(F.count("*").alias("n"))
    return rows, report


def rewrite_moved(rows: DataFrame, path: str, unknown: str = "_misc") -> None:
    """M4. Of reclassify's rows, the packs that change are written again: the unknown bucket's, and those that products moved to, with what they held
    before. Others are not touched."""
    changed = rows.where("moved").select("brand_slug").distinct().unionByName(rows.where("moved").limit(1).select(F.lit(unknown).alias("brand_slug")))
    write_packs(rows.join(changed, "brand_slug", "left_semi").drop("moved"), path)


def quality_profile(products: DataFrame, source: str = "source") -> DataFrame:
    """M5. Rows without image, price or path, of each source."""
    return products.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("images.thumb"), F.lit("")) == "").alias("no_image"),
        F.count_if(F.coalesce(F.col("price"), F.lit(0)) == 0).alias("no_price"), F.count_if(F.coalesce(F.size("cat_path"), F.lit(0)) <= 0).alias("no_path"),
    )
