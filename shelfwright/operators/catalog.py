"""The ordered, faceted catalogue feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staging_dir

PAGE = 60


def category_rank(category: Column, order: list[str]) -> Column:
    """Place of a category in the fixed order; unknown ones last."""
    at = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(at == 0, F.lit(99)).otherwise(at - 1).cast("int")


def catalogue_order(order: list[str], pseudo: tuple[str, ...] = ("_misc", "_custom"), last: tuple[str, ...] = ("id",)) -> list[Column]:
    """O1. Category rank, pseudo brands last, display name, sub category, price descending (price, else dollars, else 0), load order."""
    price = F.coalesce(F.when(F.col("p") != 0, F.col("p").cast("double")), F.when(F.col("usd") != 0, F.col("usd")), F.lit(0.0))
    return [category_rank(F.col("c"), order), F.col("s").isin(*pseudo), F.col("b"), F.col("sub"), F.desc(price), *[F.col(c) for c in last]]


def unseen_category_rank(cards: DataFrame, category: str, known: list[str], ord_: str) -> DataFrame:
    """W5. (category, rank): the fixed order, then other categories by their first appearance. Counted over one row a category."""
    first = cards.groupBy(category).agg(F.min(ord_).alias("_first"))
    fixed = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(category))
    return first.select(category, F.row_number().over(Window.orderBy(F.when(fixed > 0, fixed).otherwise(len(known) + 1), "_first")).alias("rank"))


def archive_order(order: list[str], first: list[str], second: list[str], last: tuple[str, ...] = ("id",)) -> list[Column]:
    """O2. The archived order: category rank, larger groups first (with_group_counts of `first` and `second`), the groups' names, price
    descending, load order."""
    price = F.coalesce(F.when(F.col("p") != 0, F.col("p").cast("double")), F.when(F.col("usd") != 0, F.col("usd")), F.lit(0.0))
    return [category_rank(F.col("c"), order), F.desc("n_1"), F.col(first[-1]), F.desc("n_2"), F.col(second[-1]), F.desc(price), *[F.col(c) for c in last]]


def with_group_counts(cards: DataFrame, *groups: list[str]) -> DataFrame:
    """W4. The size of each group on each of its rows (n_1, n_2, ...), as sort keys. Groups are aggregated and joined back, so that a
    large one is never one task's."""
    for i, g in enumerate(groups, 1):
        cards = cards.join(cards.groupBy(*g).agg(F.count("*").alias(f"n_{i}")), g)
    return cards


def facet_counts(cards: DataFrame, category: str = "c", brand: str = "s", sub: str = "sub") -> DataFrame:
    """A9 (A5, A7, A8). All facet levels at once: (level, category, brand, sub, n). Level 0 all, 1 category, 2 category and brand, 3 with
    sub category."""
    sets = [[], [category], [category, brand], [category, brand, sub]]
    grouped = cards.groupingSets([[F.col(x) for x in s] for s in sets], category, brand, sub)
    level = F.when(F.grouping_id() == 7, 0).when(F.grouping_id() == 3, 1).when(F.grouping_id() == 1, 2).otherwise(3)
    return grouped.agg(level.alias("level"), F.count("*").alias("n")).select("level", F.col(category).alias("category"), F.col(brand).alias("brand"), F.col(sub).alias("sub"), "n")


def brands_per_category(cards: DataFrame, category: str = "c", brand: str = "s", pseudo: tuple[str, ...] = ("_misc", "_custom"), approximate: bool = False) -> DataFrame:
    """A6. Distinct real brands of each category."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return cards.where(~F.col(brand).isin(*pseudo)).groupBy(category).agg(count(brand).alias("brands"))


def zero_filled(counts: DataFrame, categories: DataFrame, key: str, n: str) -> DataFrame:
    """A17. A count for every category of the fixed list, 0 where there is none."""
    return categories.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def facet_filter(cards: DataFrame, category: str | None = None, brand: str | None = None, sub: str | None = None) -> DataFrame:
    """F6. Any of the three filters."""
    for column, value in (("c", category), ("s", brand), ("sub", sub)):
        if value is not None:
            cards = cards.where(F.col(column) == value)
    return cards


def numbered_rows(cards: DataFrame, listing: list[str], order: list[Column], before: str) -> DataFrame:
    """Each row's place in its listing (`pos`, from 1), the listing's size (`total`), and column `before` of the row in front (`front`).

    Rows are dealt out by ranges of (listing, order) and written; a row's place is that in its range plus the sizes of the listing's
    earlier ranges. So a listing of any size is spread over all tasks; only a row for each listing and range is looked at by itself.
    """
    spark = cards.sparkSession
    keys = [F.col(c) for c in listing]
    dealt = cards.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()
    path = staging_dir(spark)
    dealt.withColumn("_at", at).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    heads = rows.groupBy(*listing, "_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"), F.max_by(before, "_at").alias("_last"))
    w = Window.partitionBy(*listing).orderBy("_range")
    sums = heads.select(*listing, "_range", "_low", (F.sum("_n").over(w) - F.col("_n")).alias("_skip"), F.sum("_n").over(Window.partitionBy(*listing)).alias("total"), F.lag("_last").over(w).alias("_front"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*listing, "_range"]]
    out = rows.alias("a").join(sums.alias("b"), same)
    own = Window.partitionBy(*[F.col(f"a.{c}") for c in [*listing, "_range"]]).orderBy("a._at")
    first = F.col("a._at") == F.col("b._low")
    return out.select(
        *[F.col(f"a.{c}") for c in cards.columns], (F.col("a._at") - F.col("_low") + F.col("_skip") + 1).cast("bigint").alias("pos"), F.col("total"),
        F.when(first, F.col("_front")).otherwise(F.lag(F.col(f"a.{before}")).over(own)).alias("front"),
    )


def paged(cards: DataFrame, order: list[Column], header: str, page_size: int = PAGE) -> DataFrame:
    """W6, W7. Display position, page, rows that remain behind it, and whether a group header stands before a row: one listing of all rows."""
    return paged_by(cards.withColumn("_all", F.lit(1)), ["_all"], order, header, page_size).drop("_all")


def paged_by(cards: DataFrame, listing: list[str], order: list[Column], header: str, page_size: int = PAGE) -> DataFrame:
    """W6, W7 for every listing at once: pos, page (from 0), remaining, header."""
    rows = numbered_rows(cards, listing, order, header)
    rows = rows.withColumn("header", ~F.col(header).eqNullSafe(F.col("front")) | (F.col("pos") == 1))
    return rows.withColumn("page", F.floor((F.col("pos") - 1) / page_size).cast("int")).withColumn("remaining", (F.col("total") - F.col("pos")).cast("bigint")).drop("total", "front")


def facet_query(cards: DataFrame, order: list[Column], category: str | None = None, brand: str | None = None, sub: str | None = None, page: int = 0) -> tuple[DataFrame, DataFrame]:
    """The client's query: rows of one page, and the facet counts of what the filters leave."""
    left = facet_filter(cards, category, brand, sub)
    return paged(left, order, "sub").where(F.col("page") == page), facet_counts(left)


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """O5, O8. The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def tiles(brands: DataFrame, name: str, locale: str = "ko") -> DataFrame:
    """O3. Brand tiles in a locale's order."""
    return brands.orderBy(F.collate(name, locale), "slug")


def numbered(categories: DataFrame, order: str) -> DataFrame:
    """W10. Two-digit numbers of the top categories, in their order (one row a category)."""
    return categories.withColumn("no", F.lpad(F.row_number().over(Window.orderBy(order)).cast("string"), 2, "0"))


def skip_names(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """F3."""
    return df.where(~F.coalesce(F.col(column), F.lit("")).rlike(pattern))
