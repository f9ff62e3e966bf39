"""Sources at rest: brand packs, checkpoints, walks, dictionaries, run logs; API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, clean_text_html, first_nonempty, img_src, join_categories, minor_to_major, present, price_num, price_policy, stable_id

IMAGES = "struct<thumb:string,main:array<string>,detail:array<string>>"
PRODUCT = (
    "id string, source string, source_id string, name string, brand string, brand_slug string, category string, cat_path array<string>, ca_id string, cate_no string,"
    f" price bigint, price_usd double, sku string, list_price bigint, sale_price bigint, inquiry boolean, source_url string, images {IMAGES}"
)
PACK = f"brand string, brand_slug string, products map<string, struct<{', '.join(f.replace(' ', ':', 1) for f in PRODUCT.split(', '))}>>"


def read_packs(spark: SparkSession, path: str, skip: tuple[str, ...] = ("_index",)) -> DataFrame:
    """S1. All packs of a folder, a row a product: the record's slug, else the pack's, else the file's stem; file_ord and pos
    keep the reading order (sorted file names, then place in the file)."""
    raw = spark.read.schema(PACK).option("multiLine", True).json(path).select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("file_stem"))
    raw = raw.where(~F.col("file_stem").isin(*skip))
    names = raw.select("file_stem").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file_stem")))  # a row a file
    rows = raw.select("file_stem", F.col("brand").alias("pack_brand"), F.col("brand_slug").alias("pack_slug"), F.posexplode(F.map_entries("products")).alias("pos", "entry"))
    p = "entry.value."
    fields = [f.split(" ")[0] for f in PRODUCT.split(", ")]
    own = {"id": first_nonempty(F.col(p + "id"), F.col("entry.key")), "brand_slug": first_nonempty(F.col(p + "brand_slug"), F.col("pack_slug"), F.col("file_stem"))}
    return rows.join(names, "file_stem").select(*[own.get(f, F.col(p + f)).alias(f) for f in fields], "pack_brand", "file_stem", "file_ord", "pos")


def parse_checkpoints(raw: DataFrame) -> DataFrame:
    """S7. (site, kind, key) of checkpoint texts (site, value) in any of three shapes: a bare list of categories, {cats, ids}, {pages, ids}."""
    listed = F.from_json("value", "array<string>")
    keyed = F.from_json("value", "cats array<string>, ids array<string>, pages array<string>")
    none = F.array().cast("array<string>")
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    pairs = lambda kind, xs: F.transform(F.coalesce(xs, none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    keys = F.when(bare, pairs("cat", listed)).otherwise(F.concat(pairs("cat", keyed["cats"]), pairs("id", keyed["ids"]), pairs("page", keyed["pages"])))
    return raw.select("site", F.explode(keys).alias("k")).select("site", "k.kind", "k.key")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """S7. Checkpoint files (<site>_done.json). Spark doesn't list files whose names begin with an underscore; stage them without it."""
    raw = spark.read.option("wholetext", True).text(path)
    return parse_checkpoints(raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)_done\.json", 1).alias("site"), "value"))


def walk_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S8. membership (site, sid, code) and paths (site, code, path) of walks (site, membership, paths), one or more a site."""
    return raw.select("site", F.explode("membership").alias("sid", "code")), raw.select("site", F.explode("paths").alias("code", "path"))


WALK = "membership map<string,string>, paths map<string,array<string>>"


def read_walks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8. Walk files (catwalk_<site>.json)."""
    raw = spark.read.schema(WALK).option("multiLine", True).json(path)
    return walk_tables(raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^catwalk_(.*?)\.json", 1).alias("site"), "*"))


def read_dictionary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9. A JSON dictionary or list; a missing file is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


REGISTRY = "total bigint, brands array<struct<slug:string,kr:string,en:string,in_rainbow:boolean,in_supplier:boolean,in_scrape:boolean,count:bigint>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """S9. The brands of registry files, a row a brand; names that are missing are the slug and its upper case."""
    rows = read_dictionary(spark, path, REGISTRY).select(F.explode("brands").alias("b")).select("b.*")
    return rows.withColumn("kr", first_nonempty(F.col("kr"), F.col("slug"))).withColumn("en", first_nonempty(F.col("en"), F.upper("slug")))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """S9. (url) of blocklist files, each a JSON list; a missing file blocks nothing, and so does one that is no list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "url string")
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("url")).where("url <> ''").distinct()


def code_names(spark: SparkSession, path: str) -> DataFrame:
    """S9. (code, name) of a file that is one object {code: name}."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "name"))


def parse_run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """S10. Events of a run log: (kind, site, done, total, mapped, multi) for progress, result and completion lines."""
    v = F.col(column)
    number = lambda pattern: F.regexp_extract(v, pattern, 1).try_cast("bigint")
    progress = r"(\S+) \D*(\d+)/(\d+) \(\D*(\d+)\)"
    result = r"catwalk_(\w+)\.json \(\D*(\d+), \D*\d\D+(\d+)\)"
    kind = F.when(v.rlike(result), "result").when(v.rlike(progress), "progress").when(v.rlike(r"(?i)\b(done|complete|finished)\b"), "complete")
    site = F.when(kind == "result", F.regexp_extract(v, result, 1)).when(kind == "progress", F.regexp_extract(v, progress, 1))
    out = lines.select(
        kind.alias("kind"), site.alias("site"), F.when(kind == "progress", number(r"(\d+)/\d+")).alias("done"), F.when(kind == "progress", number(r"\d+/(\d+)")).alias("total"),
        F.when(kind == "progress", number(r"\(\D*(\d+)\)")).when(kind == "result", F.regexp_extract(v, result, 2).try_cast("bigint")).alias("mapped"), F.when(kind == "result", F.regexp_extract(v, result, 3).try_cast("bigint")).alias("multi"),
    )
    return out.where(F.col("kind").isNotNull())


STORE = (
    "array<struct<id:bigint,name:string,permalink:string,sku:string,prices:struct<price:string,regular_price:string>,"
    "categories:array<struct<id:bigint,name:string>>,images:array<struct<src:string>>,description:string,short_description:string>>"
)


def read_store_api(payloads: DataFrame, site: str, column: str = "value", usd: bool = False, default_category: str = "etc") -> DataFrame:
    """S5. Products of store-API answers (a JSON array a row). Nameless records are skipped (F4); minor units of a dollar
    shop become price_usd."""
    p = payloads.select(F.explode(F.from_json(column, STORE)).alias("p")).select("p.*")
    p = p.withColumn("name", clean_text_html(F.col("name"))).where("name <> ''")
    now, full = F.coalesce(F.col("prices.price").try_cast("bigint"), F.lit(0)), F.coalesce(F.col("prices.regular_price").try_cast("bigint"), F.lit(0))
    policy = price_policy(full, now, "equal_is_none")
    details = F.concat(img_src(F.coalesce("description", F.lit(""))), img_src(F.coalesce("short_description", F.lit(""))))
    shown = F.transform("images", lambda i: i["src"])
    zero = F.lit(0).cast("bigint")
    return p.select(
        stable_id(F.lit(site), F.col("id").cast("string")).alias("id"), F.lit(site).alias("source"), F.col("id").cast("string").alias("source_id"), "name", "sku",
        join_categories(F.transform("categories", lambda c: clean_text_html(c["name"])), 3, default_category).alias("category"),
        (zero if usd else policy["price"]).alias("price"), F.when(F.lit(usd), minor_to_major(now)).alias("price_usd"), policy["list_price"].alias("list_price"), policy["sale_price"].alias("sale_price"),
        policy["inquiry"].alias("inquiry"), F.col("permalink").alias("source_url"),
        F.struct(F.coalesce(F.try_element_at(shown, F.lit(1)), F.lit("")).alias("thumb"), F.slice(shown, 1, 6).alias("main"), F.array_distinct(details).alias("detail")).alias("images"),
    )


def split_payloads(payloads: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """S1, S5, S6. Payloads that hold what `schema` (an array or a struct) asks for, and the others with a `reason`: empty, no JSON, or another shape. All columns stay
    on both sides, such as the file that a payload is from; nothing is lost."""
    text = F.col(column)
    parsed = F.try_parse_json(text)
    asked = "ARRAY" if schema.lstrip().lower().startswith("array") else "OBJECT"
    reason = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(parsed.isNull(), "no JSON").when(~F.startswith(F.schema_of_variant(parsed), F.lit(asked)) | F.from_json(text, schema).isNull(), "another shape")
    marked = payloads.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def split_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1. Pack files (file, value) that can be read as packs, and a quarantine of the others with the reason. Spark doesn't list files of no bytes."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return split_payloads(raw, PACK)


ITEMS = "itemList array<struct<itemId:string,itemNm:string,brndNm:string,spprc:string,slprc:string,prcInqYn:string,dspCateSclNm:string,dspCateMclNm:string,itemPcAtchFilePath:string,itemAtchFilePath:string>>, paginationInfo struct<totalPageCount:int>"


def read_item_list(payloads: DataFrame, page_no: str = "page_no", column: str = "value", listing: str = "listing") -> DataFrame:
    """S6. Items of paged list answers: first seen of each itemId, brand text in front of the name, pages up to the total only."""
    p = payloads.withColumn("j", F.from_json(column, ITEMS)).where(F.col(page_no) <= F.col("j.paginationInfo.totalPageCount"))
    p = p.select(page_no, listing, F.posexplode("j.itemList").alias("pos", "i")).select(page_no, listing, "pos", "i.*")
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy("itemId").orderBy(page_no, "pos"))).where("rn = 1")
    policy = price_policy(price_num(F.col("slprc")), price_num(F.col("spprc")), "equal_is_none")
    return p.select(
        "itemId", clean_text(F.concat_ws(" ", present(F.col("brndNm")), "itemNm")).alias("name"), policy["price"].alias("price"), policy["list_price"].alias("list_price"), policy["sale_price"].alias("sale_price"),
        (policy["inquiry"] | (F.col("prcInqYn") == "Y")).alias("inquiry"), first_nonempty(F.col("dspCateSclNm"), F.col("dspCateMclNm"), F.col(listing)).alias("category"),
        first_nonempty(F.col("itemPcAtchFilePath"), F.col("itemAtchFilePath")).alias("image"),
    )


def first_seen(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """W1. The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """W2. The row of each key that comes first in a descending order."""
    return first_seen(df, keys, *order)
