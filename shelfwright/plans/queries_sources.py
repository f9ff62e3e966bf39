"""Queries of sources and sinks on files and payloads made from the given tables, and of streams over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import policy, quality, tree
from ..sources import packs, pages as raw, sinks
from ..sources.staging import staging_dir
from ..streaming import incremental
from .registry import query
from .tables import CODES, PAGES, PRODUCTS, codes, pages, products, table


@query(
    f"""WITH {PRODUCTS} SELECT CASE WHEN ord % 3 = 0 THEN 'k' || ord ELSE id END AS id, name, CASE WHEN ord % 4 = 0 THEN 'own' ELSE lower(brand) END AS brand_slug, brand AS pack_brand, price, usd AS price_usd,
    category || '>' || brand AS path, CASE WHEN ord % 2 = 0 THEN 't' || ord ELSE '' END AS thumb, CAST(1 AS BIGINT) AS mains FROM products"""
)
def brand_packs(spark: SparkSession, d: str) -> DataFrame:
    """S1. Packs of a few hundred products each, written as JSON documents and read back. A record without id takes its key, one without
    slug the pack's."""
    p = products(spark, d)
    item = F.struct(
        F.when(F.col("ord") % 3 != 0, F.col("id")).otherwise(F.lit("")).alias("id"), F.lit("src").alias("source"), F.col("ord").cast("string").alias("source_id"), "name", "brand",
        F.when(F.col("ord") % 4 == 0, F.lit("own")).otherwise(F.lit("")).alias("brand_slug"), "category", F.array("category", "brand").alias("cat_path"), "price", F.col("usd").cast("double").alias("price_usd"),
        F.struct(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("t"), F.col("ord").cast("string"))).otherwise(F.lit("")).alias("thumb"), F.array(F.lit("m")).alias("main"), F.array().cast("array<string>").alias("detail")).alias("images"),
    )
    entry = F.struct(F.concat(F.lit("k"), F.col("ord").cast("string")).alias("key"), item.alias("value"))
    made = p.groupBy("brand", F.floor(F.col("ord") / 12_500).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("products"))
    path = staging_dir(spark)
    made.select("brand", F.lower("brand").alias("brand_slug"), "products").write.option("maxRecordsPerFile", 1).json(path)
    return packs.read_packs(spark, path).select("id", "name", "brand_slug", "pack_brand", "price", "price_usd", F.array_join("cat_path", ">").alias("path"), F.col("images.thumb").alias("thumb"), F.size("images.main").cast("bigint").alias("mains"))


@query(
    f"""WITH {PRODUCTS}, i AS (SELECT ord // 20 AS page_no, * FROM products WHERE ord // 20 <= (SELECT max(ord) // 20 - 1 FROM products)),
    x AS (SELECT 'i' || ord AS "itemId", trim(CASE WHEN ord % 3 = 0 THEN '' ELSE brand || ' ' END || name) AS name, CASE WHEN ord % 5 = 0 THEN 0 ELSE price END AS li, CASE WHEN ord % 4 = 0 THEN price WHEN ord % 5 = 0 THEN 0 ELSE price - 100 END AS sa, ord, category FROM i)
    SELECT "itemId", name, CASE WHEN li = sa OR li = 0 THEN sa ELSE li END AS price, CASE WHEN li = sa THEN 0 ELSE li END AS list_price, sa AS sale_price, CASE WHEN li = sa OR li = 0 THEN sa ELSE li END = 0 OR ord % 7 = 0 AS inquiry,
        CASE WHEN ord % 2 = 0 THEN 'small' WHEN ord % 3 = 1 THEN 'middle' ELSE 'listed' END AS category, CASE WHEN ord % 6 = 0 THEN 'b' || ord ELSE 'a' || ord END AS image FROM x"""
)
def item_list(spark: SparkSession, d: str) -> DataFrame:
    """S6, P29. Parts as pages of an item list; every page repeats an item of the page before under another name, and the last page is
    beyond the announced total."""
    p = products(spark, d)
    last = p.agg(F.max(F.floor(F.col("ord") / 20)).alias("last"))
    num = F.col("ord").cast("string")
    listed = F.when(F.col("ord") % 5 == 0, F.lit(0)).otherwise(F.col("price"))
    sale = F.when(F.col("ord") % 4 == 0, F.col("price")).when(F.col("ord") % 5 == 0, F.lit(0)).otherwise(F.col("price") - 100)
    item = F.struct(
        F.concat(F.lit("i"), num).alias("itemId"), F.col("name").alias("itemNm"), F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.col("brand")).alias("brndNm"), F.format_number(sale, 0).alias("spprc"), F.format_number(listed, 0).alias("slprc"),
        F.when(F.col("ord") % 7 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("prcInqYn"), F.when(F.col("ord") % 2 == 0, F.lit("small")).otherwise(F.lit("")).alias("dspCateSclNm"),
        F.when(F.col("ord") % 3 == 1, F.lit("middle")).otherwise(F.lit("")).alias("dspCateMclNm"), F.when(F.col("ord") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("a"), num)).alias("itemPcAtchFilePath"), F.concat(F.lit("b"), num).alias("itemAtchFilePath"),
    )
    rows = p.select(F.floor(F.col("ord") / 20).alias("page_no"), F.col("ord").alias("at"), item.alias("i"))
    again = rows.where(F.col("at") % 20 == 7).select((F.col("page_no") + 1).alias("page_no"), F.lit(-1).cast("bigint").alias("at"), F.col("i").withField("itemNm", F.lit("seen before")).alias("i"))
    made = rows.unionByName(again).groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("at", "i"))).alias("rows")).crossJoin(F.broadcast(last))  # `last` is one row
    payload = F.to_json(F.struct(F.transform("rows", lambda r: r["i"]).alias("itemList"), F.struct((F.col("last") - 1).alias("totalPageCount")).alias("paginationInfo")))
    return packs.read_item_list(made.select("page_no", F.lit("listed").alias("listing"), payload.alias("value")))


@query(
    """SELECT site, kind, key FROM (SELECT DISTINCT 'n' || s_nationkey AS site, CASE s_nationkey % 3 WHEN 0 THEN 'cat' WHEN 1 THEN 'id' ELSE 'page' END AS kind, CAST(s_suppkey AS VARCHAR) AS key FROM supplier)
    UNION ALL SELECT DISTINCT 'n' || s_nationkey, 'cat', 'c' || s_nationkey FROM supplier WHERE s_nationkey % 3 = 1"""
)
def checkpoint_keys(spark: SparkSession, d: str) -> DataFrame:
    """S7. Suppliers as checkpoint texts in the three shapes: a bare list, {cats, ids} and {pages, ids}."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(F.col("s_suppkey").cast("string"))).alias("keys"))
    keys, kind = F.col("keys"), F.col("s_nationkey") % 3
    site = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    own = F.array(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")))
    text = F.when(kind == 0, F.to_json(keys)).when(kind == 1, F.to_json(F.struct(own.alias("cats"), keys.alias("ids")))).otherwise(F.to_json(F.struct(keys.alias("pages"), F.array().cast("array<string>").alias("ids"))))
    return packs.parse_checkpoints(s.select(site.alias("site"), text.alias("value")))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders")
def stored_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """K7. Keys appended in two runs that overlap; a reader takes them together."""
    path = staging_dir(spark)
    o = table(spark, d, "orders")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 3 > 0 or o_orderkey % 2 = 1"):
        sinks.write_checkpoint(o.where(part).select(F.col("o_custkey").cast("string").alias("key")), path)
    return spark.read.schema("key string").json(path).distinct()


@query(
    """WITH m AS (SELECT 'n' || c_nationkey AS site, CAST(c_custkey AS VARCHAR) AS sid, lower(c_mktsegment) AS code FROM customer)
    SELECT m.site, m.sid, m.code, n_name || ' > ' || m.code AS path FROM m JOIN nation ON m.site = 'n' || n_nationkey"""
)
def walk_files(spark: SparkSession, d: str) -> DataFrame:
    """K6, S8. Membership and paths written as walk files, in parts of some hundred entries, and read back."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    site = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("site")
    m = c.select(site, F.col("c_custkey").cast("string").alias("sid"), F.lower("c_mktsegment").alias("code"))
    p = c.select(site, F.lower("c_mktsegment").alias("code"), F.array("n_name", F.lower("c_mktsegment")).alias("path")).distinct()
    path = staging_dir(spark)
    sinks.walk_maps(m, p, 300).write.json(path)
    membership, paths = packs.walk_tables(spark.read.schema(f"site string, {packs.WALK}").json(path))
    return membership.join(paths, ["site", "code"]).select("site", "sid", "code", F.array_join("path", " > ").alias("path"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name FROM supplier")
def dictionary_names(spark: SparkSession, d: str) -> DataFrame:
    """S9. Dictionary files {code: name}; a dictionary that is not there is empty."""
    path = staging_dir(spark)
    s = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 200).alias("part"))
    made = s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("v"))))).alias("value"))
    made.select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    none = packs.read_dictionary(spark, f"{path}/none", "code string, name string")
    return packs.code_names(spark, path).unionByName(none)


_BROKEN = "CASE ord % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'no JSON' WHEN 2 THEN 'another shape' WHEN 3 THEN 'no JSON' ELSE 'good' END"


@query(f"WITH {PRODUCTS} SELECT {_BROKEN} AS reason, 'file' || ord % 7 AS file, count(*) AS n, sum(CASE WHEN {_BROKEN} = 'good' THEN ord ELSE 0 END)::BIGINT AS ids FROM products GROUP BY ALL")
def quarantined_payloads(spark: SparkSession, d: str) -> DataFrame:
    """S5. Store-API answers of which some are empty, cut off, of another shape or no JSON at all: products of the good ones, and the others by reason and file."""
    p = products(spark, d)
    good = F.to_json(F.array(F.struct(F.col("ord").alias("id"), "name")))
    k = F.col("ord") % 10
    value = F.when(k == 0, F.lit(" ")).when(k == 1, F.substring(good, F.lit(1), F.length(good) - 3)).when(k == 2, F.to_json(F.struct(F.lit("no list").alias("error")))).when(k == 3, F.lit("<html>503</html>")).otherwise(good)
    rows = p.select(value.alias("value"), F.concat(F.lit("file"), (F.col("ord") % 7).cast("string")).alias("file"))
    fine, broken = packs.split_payloads(rows, packs.STORE)
    ids = fine.select("file", F.lit("good").alias("reason"), F.explode(F.from_json("value", packs.STORE)).alias("x")).select("file", "reason", F.col("x.id").alias("id"))
    both = ids.unionByName(broken.select("file", "reason", F.lit(0).cast("bigint").alias("id")))
    return both.groupBy("reason", "file").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT lower(p_brand) AS slug, CASE WHEN p_brand < 'Brand#2' THEN lower(p_brand) ELSE 'kr ' || p_brand END AS kr, upper(p_brand) AS en, count(*) AS count FROM part GROUP BY p_brand")
def registry_files(spark: SparkSession, d: str) -> DataFrame:
    """S9. Registry files {total, brands} written and read back; a registry that is not there has no brands."""
    path = staging_dir(spark)
    b = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("count"))
    brand = F.struct(F.lower("p_brand").alias("slug"), F.when(F.col("p_brand") < "Brand#2", F.lit("")).otherwise(F.concat(F.lit("kr "), "p_brand")).alias("kr"), F.lit(None).cast("string").alias("en"), "count")
    b.groupBy(F.pmod(F.xxhash64("p_brand"), F.lit(3))).agg(F.count("*").alias("total"), F.collect_list(brand).alias("brands")).select("total", "brands").write.option("maxRecordsPerFile", 1).json(path)
    return packs.read_registry(spark, path).unionByName(packs.read_registry(spark, f"{path}/none")).select("slug", "kr", "en", "count")


@query(f"WITH {PRODUCTS} SELECT id, 'u' || (ord % 50) AS url FROM products WHERE ord % 50 NOT IN (SELECT p_size FROM part WHERE p_size % 3 = 0)")
def blocklist_files(spark: SparkSession, d: str) -> DataFrame:
    """S9, F5. Blocklist files (JSON lists) written, read back and applied."""
    path = staging_dir(spark)
    sizes = table(spark, d, "part").where("p_size % 3 = 0").groupBy((F.col("p_size") % 2).alias("part")).agg(F.to_json(F.collect_set(F.concat(F.lit("u"), F.col("p_size").cast("string")))).alias("value"))
    sizes.select("value").repartition(2, "value").write.option("maxRecordsPerFile", 1).text(path)
    rows = products(spark, d).select("id", F.concat(F.lit("u"), (F.col("ord") % 50).cast("string")).alias("url"))
    blocked = packs.read_blocklist(spark, path).unionByName(packs.read_blocklist(spark, f"{path}/none"))
    return policy.block_url_rows(rows, blocked).select("id", "url")


@query(f"WITH {PRODUCTS} SELECT least(40, count(*)) AS n, true AS known FROM products")
def sampled_files(spark: SparkSession, d: str) -> DataFrame:
    """O6. A sample build of 40 documents, each of them a product's."""
    path = staging_dir(spark)
    p = products(spark, d).select(F.lower("brand").alias("brand_slug"), "id", F.concat(F.lit("<b>"), "name", F.lit("</b>")).alias("doc"))
    sinks.write_product_docs(p, path, 40)
    found = spark.read.schema("id string, doc string, brand_slug string").json(path)
    return found.join(p.withColumn("known", F.lit(True)), ["id", "doc", "brand_slug"], "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


@query(f"""WITH {PRODUCTS}, x AS (SELECT id, name, CASE WHEN ord % 2 = 0 THEN '_misc' ELSE lower(brand) END AS old, CASE WHEN ord % 6 = 0 THEN lower(brand) END AS new FROM products)
    SELECT coalesce(new, old) AS brand_slug, id, replace('m/' || old || '/' || id, '/_misc/', '/' || coalesce(new, '_misc') || '/') AS thumb FROM x""")
def moved_packs(spark: SparkSession, d: str) -> DataFrame:
    """M4, C11. Products of the unknown bucket move to the brands found since; the packs that change are written again."""
    path = staging_dir(spark)
    p = products(spark, d).withColumn("brand_slug", F.when(F.col("ord") % 2 == 0, F.lit("_misc")).otherwise(F.lower("brand")))
    none = F.array().cast("array<string>")
    packs_ = p.select("id", "name", "brand_slug", F.struct(F.concat_ws("/", F.lit("m"), "brand_slug", "id").alias("thumb"), none.alias("main"), none.alias("detail")).alias("images"))
    sinks.write_packs(packs_, path)
    rows, _ = quality.reclassify(packs_, p.where("ord % 6 = 0").select("id", F.lower("brand").alias("slug")))
    quality.rewrite_moved(rows, path)
    return spark.read.parquet(path).select("brand_slug", "id", F.col("images.thumb").alias("thumb"))


@query(
    """SELECT kind, site, mapped, multi, count(*) AS n FROM (SELECT 'result' AS kind, 'site' || (event_id % 5) AS site, event_id AS mapped, user_id AS multi FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT 'complete', '', -1, -1 FROM events WHERE event_id % 4 = 1) GROUP BY ALL"""
)
def run_results(spark: SparkSession, d: str) -> DataFrame:
    """S10. Result and completion lines of run logs."""
    e = table(spark, d, "events")
    result = F.format_string("catwalk_site%d.json (mapped %d, of 2 levels %d)", F.col("event_id") % 5, F.col("event_id"), F.col("user_id"))
    line = F.when(F.col("event_id") % 4 == 0, result).when(F.col("event_id") % 4 == 1, F.lit("all done")).otherwise(F.lit("---"))
    found = packs.parse_run_log(e.select(line.alias("value")))
    return found.groupBy("kind", F.coalesce("site", F.lit("")).alias("site"), F.coalesce("mapped", F.lit(-1)).alias("mapped"), F.coalesce("multi", F.lit(-1)).alias("multi")).agg(F.count("*").alias("n"))


@query(f"WITH {PRODUCTS} SELECT lower(brand) AS brand_slug, id, '<b>' || name || '</b>' AS doc FROM products")
def product_files(spark: SparkSession, d: str) -> DataFrame:
    """K4, O6. A document for each product, in folders by slug, read back."""
    path = staging_dir(spark)
    p = products(spark, d).select(F.lower("brand").alias("brand_slug"), "id", F.concat(F.lit("<b>"), "name", F.lit("</b>")).alias("doc"))
    sinks.write_product_docs(p.repartition("brand_slug"), path)
    return spark.read.schema("id string, doc string, brand_slug string").json(path).select("brand_slug", "id", "doc")


@query(f"WITH {PRODUCTS} SELECT 'why' || ord % 2 AS reason, '2024-01-0' || (1 + ord % 2) AS deleted_at, id AS pid, name, category AS source, brand AS path FROM products WHERE ord % 5 = 0")
def removal_archive(spark: SparkSession, d: str) -> DataFrame:
    """K9. Two removals appended to one archive."""
    path = staging_dir(spark)
    p = products(spark, d).where("ord % 5 = 0").select("ord", "id", "name", F.col("category").alias("source"), F.array("brand").alias("cat_path"))
    for k in range(2):
        sinks.archive_removed(p.where(F.col("ord") % 2 == k), f"why{k}", f"2024-01-0{1 + k}", path)
    found = spark.read.schema("deleted_at string, reason string, pid string, name string, source string, cat_path array<string>").json(path)
    return found.select("deleted_at", "reason", "pid", "name", "source", F.array_join("cat_path", ">").alias("path"))


@query(f"WITH {PRODUCTS} SELECT lower(brand) AS brand_slug, id, CASE WHEN ord % 7 = 0 AND brand < 'Brand#2' THEN 'changed' ELSE name END AS name FROM products")
def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    """K8, K1. A dry run changes nothing; applied, only the slugs with changed rows are written again."""
    path = staging_dir(spark)
    before = products(spark, d).select(F.lower("brand").alias("brand_slug"), "id", "name", "ord")
    after = before.withColumn("name", F.when((F.col("ord") % 7 == 0) & (F.col("brand_slug") < "brand#2"), F.lit("changed")).otherwise(F.col("name")))
    sinks.write_packs(before, path)
    for apply in (False, True):
        sinks.apply_changes(before, after, ["id"], ["name"], path, apply)
    return spark.read.parquet(path).select("brand_slug", "id", "name")


@query(
    f"""WITH {PRODUCTS} SELECT 'api-' || ord AS id, array_to_string([x FOR x IN ['i' || ord || '-' || k FOR k IN range(1, 9)] IF CAST(split_part(x, '-', 2) AS INT) <= least(6, ord % 9)], ',') AS main FROM products"""
)
def store_images(spark: SparkSession, d: str) -> DataFrame:
    """O7. The first six images of a store's products."""
    p = products(spark, d)
    images = F.filter(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.when(k <= F.col("ord") % 9, F.struct(F.concat_ws("-", F.concat(F.lit("i"), F.col("ord").cast("string")), k.cast("string")).alias("src")))), lambda x: x.isNotNull())
    record = F.struct(F.col("ord").alias("id"), "name", images.alias("images"))
    found = packs.read_store_api(p.select(F.to_json(F.array(record)).alias("value")), "api")
    return found.select("id", F.array_join("images.main", ",").alias("main"))


@query(f"WITH {PRODUCTS} SELECT id, 'u' || (ord % 50) AS url FROM products WHERE ord % 50 NOT IN (3, 7, 21)")
def blocked_urls(spark: SparkSession, d: str) -> DataFrame:
    """F5 for rows."""
    rows = products(spark, d).select("id", F.concat(F.lit("u"), (F.col("ord") % 50).cast("string")).alias("url"))
    return policy.block_url_rows(rows, spark.createDataFrame([("u3",), ("u7",), ("u21",), ("u21",)], "url string")).select("id", "url")


@query("SELECT DISTINCT user_id, event_type FROM events")
def unseen_stream(spark: SparkSession, d: str) -> DataFrame:
    """T1. The keys of an event stream, each once, by a stateful stream over the files of two deliveries that overlap."""
    path = staging_dir(spark)
    e = table(spark, d, "events").select("user_id", "event_type")
    for part in ("user_id % 3 > 0", "user_id % 3 < 2"):
        e.where(part).write.mode("append").parquet(f"{path}/in")
    stream = incremental.unseen(incremental.file_stream(spark, f"{path}/in", e.schema, 1000), ["user_id", "event_type"])
    incremental.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/v={n}"), f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("user_id", "event_type")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def upserted_stream(spark: SparkSession, d: str) -> DataFrame:
    """T2, T6. The latest event of each user and type, by a stream that takes the newer half first, so that the other comes late."""
    path = staging_dir(spark)
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    for part in ("event_id % 2 = 1", "event_id % 2 = 0"):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        incremental.upsert_stream(incremental.file_stream(spark, f"{path}/in", e.schema, 1000), ["user_id", "event_type"], "event_id", f"{path}/table", f"{path}/state").awaitTermination()
    return incremental.read_version(spark, f"{path}/table").select("user_id", "event_type", "event_id", "value")


def _title_parser(frames):
    for f in frames:
        yield pd.DataFrame({"page_id": f["page_id"], "n_links": f["html"].str.count("<a "), "n_paragraphs": f["html"].str.count("<p>")})


@query(f"WITH {PAGES} SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pg")
def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    """X2. Pages read by a parser of their own."""
    return raw.parse_with(pages(spark, d).select("page_id", "html"), _title_parser, "page_id bigint, n_links bigint, n_paragraphs bigint")


@query(f"WITH {PRODUCTS} SELECT id, name || ' é & <A> €  x &nope; ' || ord AS plain, trim(regexp_replace(name || ' é & <A> €  x &nope; ' || ord, '[\\s ]+', ' ', 'g')) AS cleaned FROM products")
def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    """P2, X3. Named and numbered character references of every kind, by the Arrow function and by expressions."""
    text = F.concat("name", F.lit(" &eacute; &amp; &lt;&#65;&gt; &#x20AC; &nbsp;x &nope; "), F.col("ord").cast("string"))
    return products(spark, d).select("id", T.unescape_all(text).alias("plain"), T.clean_text_html(text).alias("cleaned"))


@query(f"WITH {PRODUCTS} SELECT id, CASE WHEN ord % 3 = 0 THEN 'x' || ord ELSE '' END AS thumb FROM products WHERE ord % 3 = 0 OR ord % 2 = 1")
def pictured_changes(spark: SparkSession, d: str) -> DataFrame:
    """K8, M1. Thumbnails promoted from detail images, the changed rows and those without an image."""
    p = products(spark, d)
    none = F.array().cast("array<string>")
    images = F.struct(F.lit("").alias("thumb"), none.alias("main"), F.when(F.col("ord") % 3 == 0, F.array(F.concat(F.lit("x"), F.col("ord").cast("string")))).otherwise(none).alias("detail"))
    before = p.select("id", "ord", F.lit("s").alias("source"), F.lit("b").alias("brand_slug"), images.alias("images"))
    after = quality.promote_thumbs(before)
    moved = sinks.changed(before, after.select(*before.columns), ["id"], ["images"])
    rest = after.where((F.col("images.thumb") == "") & (F.col("ord") % 2 == 1)).select(*before.columns)
    return moved.unionByName(rest).select("id", F.col("images.thumb").alias("thumb"))


@query(f"WITH {CODES} SELECT code FROM codes c WHERE NOT EXISTS (SELECT 1 FROM codes o WHERE o.site = c.site AND o.code <> c.code AND starts_with(o.code, c.code))")
def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    """J5 on the region, nation and segment tree: segments, and nations or regions without any."""
    return tree.leaves(codes(spark, d)).select("code")
