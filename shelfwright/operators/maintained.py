"""Results that are kept up to date from changes, or looked up, instead of being worked out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged
from .catalog import PAGE, paged_by

#: Parts of a maintained table; a batch reads and rewrites those that its groups fall into.
BUCKETS = 64
GROUP = ["level", "category", "brand", "sub"]


def signed(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Changes as signed rows (columns, sign): what a row was with -1, what it is with +1; rows that didn't change are left out."""
    old, new = (df.select(*keys, F.struct(*columns).alias(name)) for df, name in ((before, "_old"), (after, "_new")))
    both = old.join(new, keys, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    sides = F.array(F.struct(F.col("_old").alias("row"), F.lit(-1).alias("sign")), F.struct(F.col("_new").alias("row"), F.lit(1).alias("sign")))
    return both.select(F.explode(sides).alias("x")).where("x.row is not null").select("x.row.*", "x.sign")


def facet_deltas(changes: DataFrame, category: str = "c", brand: str = "s", sub: str = "sub") -> DataFrame:
    """A5, A7-A9 of signed rows: (level, category, brand, sub, n), by how much each facet count changes; groups that don't change are left out."""
    sets = [[], [category], [category, brand], [category, brand, sub]]
    grouped = changes.groupingSets([[F.col(x) for x in s] for s in sets], category, brand, sub)
    level = F.when(F.grouping_id() == 7, 0).when(F.grouping_id() == 3, 1).when(F.grouping_id() == 1, 2).otherwise(3)
    rows = grouped.agg(level.alias("level"), F.sum("sign").alias("n")).where("n <> 0")
    return rows.select("level", F.col(category).alias("category"), F.col(brand).alias("brand"), F.col(sub).alias("sub"), "n")


def apply_deltas(spark: SparkSession, path: str, deltas: DataFrame, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Add a batch of deltas to the counts at `path`, and say which buckets were read and written; others are not touched. Batches are numbered upwards.
    Each row bears the last batch that it was written by, so a batch that is repeated after a crash leaves alone the buckets it has reached."""
    rows = staged(deltas.withColumn("batch", F.lit(batch)).withColumn("bucket", F.pmod(F.xxhash64(*GROUP), F.lit(buckets)).cast("int")))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # `buckets` rows at most
    if not touched:
        return []
    if _exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
        reached = [r[0] for r in old.groupBy("bucket").agg(F.max("batch").alias("b")).where(F.col("b") >= batch).collect()]
        touched = [b for b in touched if b not in reached]
        rows = rows.unionByName(old).where(F.col("bucket").isin(touched))
    merged = rows.groupBy(*GROUP, "bucket").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))
    # groups that have become empty stay as rows of 0, so that no bucket is without rows
    staged(merged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def counts(spark: SparkSession, path: str) -> DataFrame:
    """The facet counts as catalog.facet_counts gives them."""
    return spark.read.parquet(path).where("n <> 0").select(*GROUP, "n")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


#: Binary logarithm of a sketch's size; its standard error is 1.04 / sqrt(2 ** SKETCH).
SKETCH = 12


def brand_sketches(cards: DataFrame, category: str = "c", brand: str = "s", pseudo: tuple[str, ...] = ("_misc", "_custom")) -> DataFrame:
    """A6 for a batch: (category, sketch) of the distinct real brands. Sketches of batches are stored and merged."""
    return cards.where(~F.col(brand).isin(*pseudo)).groupBy(category).agg(F.hll_sketch_agg(brand, F.lit(SKETCH)).alias("sketch"))


def merged_sketches(sketches: DataFrame, category: str = "c") -> DataFrame:
    """One sketch for each category, of all batches; a brand that many batches hold counts once."""
    return sketches.groupBy(category).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """The estimated number of brands of each sketch, with three standard errors."""
    n = F.hll_sketch_estimate("sketch")
    return sketches.withColumn("brands", n).withColumn("error", F.ceil(n * 3 * 1.04 / 2 ** (SKETCH / 2))).drop("sketch")


def write_pages(cards: DataFrame, listing: list[str], order: list[Column], header: str, path: str, page_size: int = PAGE) -> None:
    """W6, W7, O1 stored for lookup: the feed sorted by listing and position, and an index of its files (listing, first and last position)."""
    rows = paged_by(cards, listing, order, header, page_size)
    spark = cards.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, *listing, "pos").sortWithinPartitions(*listing, "pos").write.parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    index = stored.groupBy("file", *listing).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    index.repartitionByRange(max(1, parts // 8), *listing, "first").sortWithinPartitions(*listing, "first").write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, listing: dict, page: int, page_size: int = PAGE) -> DataFrame:
    """A page (from 0) of a listing, from the files that hold it; the index tells them, so that what is read doesn't grow with the feed."""
    low, high = page * page_size + 1, (page + 1) * page_size
    own = [F.col(c).eqNullSafe(F.lit(v)) for c, v in listing.items()]
    index = spark.read.parquet(f"{path}/index").where((F.col("first") <= high) & (F.col("last") >= low))
    for condition in own:
        index = index.where(condition)
    files = sorted(r[0] for r in index.select("file").collect())  # those that hold the page's rows
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    rows = rows.where(F.col("pos").between(low, high))
    for condition in own:
        rows = rows.where(condition)
    return rows


def write_digested(df: DataFrame, keys: list[str], columns: list[str], path: str, buckets: int = 1024, groups: int = 32) -> None:
    """K8, M2. A table in buckets of its keys, with digests of each bucket's rows: two versions are then compared by their digests first. Buckets lie in
    `groups` folders each of which has a digest too."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    row = F.xxhash64(*keys, *columns)
    rows = df.withColumn("bucket", bucket).withColumn("grp", (F.col("bucket") % groups).cast("int"))
    rows.repartition("bucket").write.partitionBy("grp", "bucket").parquet(f"{path}/rows")
    fine = rows.groupBy("grp", "bucket").agg(F.sum(row.cast("decimal(38,0)")).alias("digest"), F.bit_xor(F.xxhash64(row)).alias("mixed"), F.count("*").alias("n"))
    staged(fine).repartition("grp").write.partitionBy("grp").parquet(f"{path}/digests")
    own = F.xxhash64("bucket", "digest", "mixed", "n")
    fine = spark_read(df, f"{path}/digests")
    fine.groupBy("grp").agg(F.sum(own.cast("decimal(38,0)")).alias("digest")).write.parquet(f"{path}/top")


def spark_read(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.parquet(path)


def changed_buckets(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(grp, bucket) of the buckets in which two tables of write_digested differ: groups with equal digests are not looked into."""
    read = lambda p: spark.read.parquet(p)
    unlike = read(f"{old}/top").alias("a").join(read(f"{new}/top").alias("b"), "grp", "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    groups = [r[0] for r in unlike.select("grp").collect()]  # `groups` rows at most
    fine = lambda p: read(f"{p}/digests").where(F.col("grp").isin(groups)).select("grp", "bucket", F.struct("digest", "mixed", "n").alias("d"))
    return fine(old).alias("a").join(fine(new).alias("b"), ["grp", "bucket"], "full_outer").where(~F.col("a.d").eqNullSafe(F.col("b.d"))).select("grp", "bucket")


def changed_rows(spark: SparkSession, old: str, new: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of `new` that are not in `old` or have other values there, from the buckets that differ."""
    differ = sorted((r["grp"], r["bucket"]) for r in changed_buckets(spark, old, new).collect())  # `buckets` rows at most
    pick = F.col("grp").isin(sorted({g for g, _ in differ})) & F.col("bucket").isin([b for _, b in differ])
    before, after = (spark.read.parquet(f"{p}/rows").where(pick).drop("grp", "bucket") for p in (old, new))
    known = before.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *columns)])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, *columns)]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return after.join(known, on, "left_anti")


#: Distinct keys of the small side that are broadcast to prune the large one; beyond it both are shuffled.
PRUNE_KEYS = 1_000_000


def without_stored(items: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """J12, J13. Items whose key is not stored, where far more keys are stored than asked for: stored keys that no item has are dropped where they are
    read, by a semi join with the items' keys, so that what is shuffled follows the items. Null keys are never stored."""
    asked = items.select(*keys).distinct()
    held = stored.select(*keys)
    if asked.limit(PRUNE_KEYS + 1).count() <= PRUNE_KEYS:
        held = held.join(F.broadcast(asked), keys, "left_semi").distinct()
    return items.join(held, keys, "left_anti")
