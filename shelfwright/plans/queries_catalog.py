"""Queries of brands, policies, classes and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import brand, catalog, classify, policy, quality
from ..sources import packs, sinks
from . import demo_rules as R
from .registry import query
from .tables import OFFERS, PRODUCTS, offers, products, table


def _case(column: str, rules, otherwise: str = "NULL") -> str:
    parts = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{out}'" for out, words in rules)
    return f"CASE {parts} ELSE {otherwise} END"


def _map(column: str, table_: dict, otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {otherwise} END"


_BRAND = "CASE " + " ".join(f"WHEN starts_with(name, '{p}') OR starts_with(replace(name, ' ', ''), '{p.replace(' ', '')}') THEN '{s}'" for p, s in R.BRANDS) + " ELSE '_misc' END"
_CLASS = f"coalesce({_case('name', R.RULES)}, {_map('category', R.HINTS)}, '{R.DEFAULT}')"
_TOPRULE = f"coalesce({_case('name', R.TOP_FIRST)}, {_map('cls', R.LEVEL1)}, '{R.TOP_DEFAULT}')"
_TOP = f"coalesce({_map('brand', R.BRAND_TOP)}, {_TOPRULE})"
_INDEX = "ix AS (SELECT id, list(DISTINCT source ORDER BY source) AS sources FROM offers GROUP BY id)"
_POLICY = f"""{OFFERS}, {_INDEX}, ok AS (SELECT o.id, o.source FROM offers o JOIN ix USING (id) WHERE CASE {' '.join(f"WHEN o.id = '{k}' THEN source = '{v}'" for k, v in R.PINNED.items())}
    WHEN list_has_any(sources, ['s1', 's2']) THEN source IN ('s1', 's2') WHEN source = '{R.DEMOTED}' THEN len(sources) = 1 ELSE true END)"""


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    return policy.with_policy(offers(spark, d), R.TIER1, R.DEMOTED, R.PINNED, key="id")


def _class(name: str = "name", category: str = "category") -> Column:
    return classify.classify(F.col(name), F.col(category), R.RULES, R.HINTS, R.DEFAULT)


def _top(df: DataFrame) -> Column:
    by_rules = classify.top_category(F.col("name"), F.col("cls"), F.lit(""), R.TOP_FIRST, {"-": "-"}, R.LEVEL1, R.TOP_DEFAULT)
    return classify.resolve_top(F.col("brand"), R.BRAND_TOP, by_rules)


_CARDS = f"""{PRODUCTS}, {_POLICY}, cl AS (SELECT p.*, source, {_CLASS} AS cls, {_BRAND} AS slug FROM products p JOIN ok USING (id)),
    cards AS (SELECT name AS n, slug AS s, id || '-' || source AS id, {_TOP} AS c, cls AS sub, CASE WHEN ord % 4 = 0 THEN 0 ELSE price END AS p, usd, CASE WHEN ord % 6 = 0 THEN '' ELSE 'img/' || id END AS t, brand, ord FROM cl)"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    """P1, J9, A1, F2, C1, C8 in one lineage: the allowed products with brand, class, top category and price."""
    p = products(spark, d).join(_allowed(spark, d), "id").withColumn("name", T.clean_text(F.col("name")))
    p = p.withColumn("cls", _class()).withColumn("slug", brand.brand_fold(F.col("name"), R.BRANDS))
    return p.select(
        F.col("name").alias("n"), F.col("slug").alias("s"), F.concat_ws("-", "id", "source").alias("id"), _top(p).alias("c"), F.col("cls").alias("sub"),
        F.when(F.col("ord") % 4 == 0, F.lit(0)).otherwise(F.col("price")).cast("bigint").alias("p"), "usd", F.when(F.col("ord") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("img/"), "id")).alias("t"), "brand", "ord",
    )


_DISPLAY = """votes AS (SELECT s, brand, count(*) AS c, min(struct_pack(o := ord, i := id)) AS f FROM cards GROUP BY ALL),
    disp AS (SELECT s, CASE WHEN s IN ('_misc', '_custom') THEN 'etc' ELSE brand END AS b FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, f) AS rn FROM votes) WHERE rn = 1),
    img AS (SELECT s, arg_min(t, struct_pack(o := ord, i := id)) AS image FROM cards WHERE t <> '' GROUP BY s)"""
_RANK = "CASE c " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(R.TOP_ORDER)) + " ELSE 99 END"
_ORDER = f"{_RANK}, s IN ('_misc', '_custom'), b, sub, coalesce(nullif(CAST(p AS DOUBLE), 0), nullif(usd, 0), 0) DESC, id"


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the display name of their brand."""
    c = cards(spark, d)
    names = brand.display_names(c, "s", "brand", ["ord", "id"]).select(F.col("slug").alias("s"), F.col("display").alias("b"))
    return c.join(names, "s")


@query(f"WITH {_CARDS}, {_DISPLAY} SELECT n, b, cards.s AS s, id, c, sub, p, usd, t, image FROM cards JOIN disp ON disp.s = cards.s LEFT JOIN img ON img.s = cards.s")
def catalog_feed(spark: SparkSession, d: str) -> DataFrame:
    """The policy-filtered, classified, ordered feed, with each brand's image."""
    c = shown(spark, d)
    images = brand.brand_images(c, "s", "t", ["ord", "id"]).select(F.col("slug").alias("s"), "image")
    return c.join(images, "s", "left").orderBy(*catalog.catalogue_order(R.TOP_ORDER)).select("n", "b", "s", "id", "c", "sub", "p", "usd", "t", "image")


@query(f"""WITH {_CARDS}, {_DISPLAY} SELECT id, '{{"n":"' || n || '","b":"' || b || '","s":"' || cards.s || '","id":"' || id || '","c":"' || c || '","sub":"' || sub || '","p":' || p || ',"t":"' || t || '"}}' AS value FROM cards JOIN disp ON disp.s = cards.s""")
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.feed_rows(shown(spark, d).drop("usd").withColumn("usd", F.lit(0.0)).drop("usd"), [F.col("id")])
    return rows.select(F.get_json_object("value", "$.id").alias("id"), "value")


@query(f"WITH {PRODUCTS} SELECT id, {_case('name', R.RULES)} AS cls FROM products")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select("id", classify.first_match(F.col("name"), R.RULES).alias("cls"))


@query(f"WITH {PRODUCTS} SELECT id, {_case('name', R.RULES)} AS cls FROM products")
def first_match_join(spark: SparkSession, d: str) -> DataFrame:
    return classify.first_match_join(products(spark, d), "name", classify.rule_table(spark, R.RULES), "cls").select("id", "cls")


@query(f"WITH {PRODUCTS} SELECT id, {_CLASS} AS cls FROM products")
def classified(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select("id", _class().alias("cls"))


@query(f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{w}')" for i, (_, ws) in enumerate(R.RULES) for w in ws)}) AS k(priority, keyword)),
    h AS (SELECT DISTINCT p_partkey, priority FROM part JOIN k ON contains(lower(p_name), keyword)), f AS (SELECT p_partkey, min(priority) AS first FROM h GROUP BY 1)
    SELECT CAST(r.priority AS BIGINT) AS priority, count(h.p_partkey) AS hits, count(*) FILTER (WHERE f.first = r.priority) AS first_hits FROM (SELECT DISTINCT priority FROM k) r LEFT JOIN h USING (priority) LEFT JOIN f USING (p_partkey) GROUP BY 1""")
def rule_audit(spark: SparkSession, d: str) -> DataFrame:
    found = classify.rule_audit(products(spark, d), "name", classify.rule_table(spark, R.RULES))
    return found.select(F.col("priority").cast("bigint").alias("priority"), F.col("hits").cast("bigint").alias("hits"), F.col("first_hits").cast("bigint").alias("first_hits"))


_LINES, _CAMS = [("plates", ["plate"]), ("rings", ["ring", "promo"])], [("red", ["red"]), ("bolt", ["bolt", "standard"])]


@query(f"""WITH {PRODUCTS}, x AS (SELECT id, name, category, category NOT IN ('economy', '') AS clean, {_case('category', _LINES)} AS l1, {_case('category', _CAMS)} AS c1, {_case('name', _CAMS)} AS c2, {_case('name', _LINES)} AS l2 FROM products)
    SELECT id, CASE WHEN clean AND l1 IS NOT NULL THEN 'prod' WHEN clean AND c1 IS NOT NULL THEN 'cam' ELSE 'deal' END AS grp, CASE WHEN clean AND l1 IS NOT NULL THEN l1 WHEN clean AND c1 IS NOT NULL THEN c1 ELSE coalesce(c2, l2, 'etc') END AS key FROM x""")
def two_stage_classes(spark: SparkSession, d: str) -> DataFrame:
    found = classify.two_stage(F.col("name"), F.col("category"), _LINES, _CAMS, ("economy", ""))
    return products(spark, d).select("id", found.alias("x")).select("id", F.col("x.group").alias("grp"), F.col("x.key").alias("key"))


_FIXES, _KNOWN = {"c011": "c1", "c044": "c4"}, ["c1", "c2", "c4", "c7"]


@query(f"""WITH {PRODUCTS}, x AS (SELECT id, {_CLASS} AS by_name, CASE ord % 4 WHEN 0 THEN 'c0110' WHEN 1 THEN 'c04499' WHEN 2 THEN 'c7' ELSE 'zz' END AS code FROM products),
    y AS (SELECT *, CASE substr(code, 1, 4) WHEN 'c011' THEN 'c1' WHEN 'c044' THEN 'c4' ELSE substr(code, 1, 4) END AS m FROM x)
    SELECT id, CASE WHEN m IN ('c1', 'c2', 'c4', 'c7') AND m = 'c4' AND by_name = 'c2' THEN 'c2' WHEN m IN ('c1', 'c2', 'c4', 'c7') THEN m ELSE by_name END AS cls FROM y""")
def trusted_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("ord") % 4 == 0, "c0110").when(F.col("ord") % 4 == 1, "c04499").when(F.col("ord") % 4 == 2, "c7").otherwise("zz")
    return products(spark, d).select("id", classify.from_code(code, _FIXES, _KNOWN, _class(), ("c4", "c2")).alias("cls"))


@query(f"""WITH {PRODUCTS} SELECT id, CASE WHEN ord % 3 = 0 AND ord % 2 = 0 THEN coalesce(nullif(CASE WHEN ord % 5 = 0 THEN '' ELSE category END, ''), 'none')
    ELSE concat_ws(' > ', CASE WHEN ord % 3 > 0 THEN brand END, CASE WHEN ord % 2 > 0 THEN name END) END AS path FROM products""")
def display_paths(spark: SparkSession, d: str) -> DataFrame:
    levels = [F.when(F.col("ord") % 3 > 0, F.col("brand")).otherwise(F.lit("")), F.when(F.col("ord") % 2 > 0, F.col("name")).otherwise(F.lit(""))]
    category = F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.col("category"))
    return products(spark, d).select("id", F.array_join(classify.display_path(levels, category, "none"), " > ").alias("path"))


@query(f"WITH {PRODUCTS} SELECT id, {_BRAND} AS slug FROM products")
def brand_fold(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select("id", brand.brand_fold(F.col("name"), R.BRANDS).alias("slug"))


_TAGGED = """tg AS (SELECT id, CASE WHEN ord % 3 = 0 THEN '[x][' || upper(name) || '] thing' ELSE name END AS title, name, ord FROM products)"""


@query(f"""WITH {PRODUCTS}, {_TAGGED} SELECT id, CASE WHEN ord % 3 = 0 THEN CASE {' '.join(f"WHEN starts_with(replace(upper(name), ' ', ''), '{p.replace(' ', '').upper()}') THEN '{s}'" for p, s in R.BRANDS)} ELSE '_misc' END ELSE {_BRAND} END AS slug FROM tg""")
def brand_join(spark: SparkSession, d: str) -> DataFrame:
    """Brands by the rule table; every third name bears its brand in a tag only."""
    p = products(spark, d).withColumn("title", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("[x]["), F.upper("name"), F.lit("] thing"))).otherwise(F.col("name")))
    rules = spark.createDataFrame([(i, x, s) for i, (x, s) in enumerate(R.BRANDS)], "priority int, prefix string, slug string")
    return brand.resolve_brands(p, rules, "title").select("id", "slug")


@query(f"WITH {OFFERS}, {_INDEX} SELECT id, array_to_string(sources, ',') AS sources FROM ix")
def source_index(spark: SparkSession, d: str) -> DataFrame:
    return policy.source_index(offers(spark, d), "id").select("id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_POLICY} SELECT id, source FROM ok")
def policy_filter(spark: SparkSession, d: str) -> DataFrame:
    return _allowed(spark, d)


@query(f"WITH {PRODUCTS} SELECT id FROM products WHERE NOT (contains(category, 'promo') OR contains(brand, 'Brand#1') OR regexp_matches(name, '(?i)OLD|hot gear'))")
def without_junk(spark: SparkSession, d: str) -> DataFrame:
    junk = policy.is_junk(F.array("brand"), F.col("category"), F.col("name"), ("promo", "Brand#1"), "OLD|hot gear")
    return products(spark, d).where(~junk).select("id")


@query(f"WITH {_CARDS}, {_DISPLAY} SELECT s AS slug, b AS display FROM disp")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    return brand.display_names(cards(spark, d), "s", "brand", ["ord", "id"])


@query(f"WITH {_CARDS}, {_DISPLAY} SELECT s AS slug, image FROM img")
def brand_images(spark: SparkSession, d: str) -> DataFrame:
    return brand.brand_images(cards(spark, d), "s", "t", ["ord", "id"])


_REG = """l1 AS (SELECT DISTINCT lower(p_brand) AS slug, CASE WHEN p_brand < 'Brand#2' THEN '' ELSE 'kr1 ' || p_brand END AS kr, 'E1 ' || p_brand AS en FROM part WHERE p_brand < 'Brand#24'),
    l2 AS (SELECT DISTINCT lower(p_brand) AS slug, 'kr2 ' || p_brand AS kr, 'E2 ' || p_brand AS en FROM part WHERE p_brand > 'Brand#15'),
    cn AS (SELECT CASE lower(p_brand) WHEN 'brand#9' THEN 'brand#8' WHEN 'brand#7' THEN 'other' ELSE lower(p_brand) END AS slug, count(*) AS count FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1),
    slugs AS (SELECT slug FROM l1 UNION SELECT slug FROM l2 UNION SELECT slug FROM cn),
    reg AS (SELECT s.slug, coalesce(nullif(l1.kr, ''), l2.kr, s.slug) AS kr, coalesce(l1.en, l2.en, upper(s.slug)) AS en, l1.slug IS NOT NULL AS in_first, l2.slug IS NOT NULL AS in_second, cn.slug IS NOT NULL AS in_scrape, coalesce(count, 0) AS count
        FROM slugs s LEFT JOIN l1 USING (slug) LEFT JOIN l2 USING (slug) LEFT JOIN cn USING (slug))"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").select("p_brand").distinct()
    slug = F.lower("p_brand").alias("slug")
    first = b.where("p_brand < 'Brand#24'").select(slug, F.when(F.col("p_brand") < "Brand#2", F.lit("")).otherwise(F.concat(F.lit("kr1 "), "p_brand")).alias("kr"), F.concat(F.lit("E1 "), "p_brand").alias("en"))
    second = b.where("p_brand > 'Brand#15'").select(slug, F.concat(F.lit("kr2 "), "p_brand").alias("kr"), F.concat(F.lit("E2 "), "p_brand").alias("en"))
    counts = brand.pack_counts(table(spark, d, "part").where("p_brand <> 'Brand#3'").withColumn("file_stem", F.lower("p_brand")), {"brand#9": "brand#8", "brand#7": "other"})
    return brand.registry([("in_first", first), ("in_second", second)], counts)


@query(f"WITH {_REG} SELECT *, (SELECT count(*) FROM reg) AS total FROM reg")
def registry(spark: SparkSession, d: str) -> DataFrame:
    return sinks.registry_rows(_registry(spark, d))


@query(f"WITH {_REG} SELECT slug, CASE WHEN in_first AND in_scrape THEN 'both' WHEN in_first THEN 'only_in_first' ELSE 'only_in_scrape' END AS side FROM reg WHERE in_first OR in_scrape")
def registry_overlap(spark: SparkSession, d: str) -> DataFrame:
    return brand.overlap(_registry(spark, d), "in_first", "in_scrape").select("slug", "side")


@query(f"WITH {_REG} SELECT slug, kr, en, count FROM reg WHERE (contains(lower(en), 'brand#2') OR contains(lower(kr), 'brand#2') OR contains(slug, 'brand#2')) AND count > 0")
def brand_search(spark: SparkSession, d: str) -> DataFrame:
    return brand.search(_registry(spark, d), "Brand#2", True).select("slug", "kr", "en", "count")


@query(f"WITH {PRODUCTS}, {_REG}, pr AS (SELECT CASE WHEN ord % 10 = 0 THEN name ELSE lower(brand) END AS slug FROM products), u AS (SELECT slug FROM pr UNION SELECT slug FROM reg) SELECT u.slug, (SELECT count(*) FROM pr WHERE pr.slug = u.slug) AS count, coalesce(kr, u.slug) AS kr, coalesce(en, u.slug) AS en FROM u LEFT JOIN reg USING (slug)")
def slug_directory(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d).select(F.when(F.col("ord") % 10 == 0, F.col("name")).otherwise(F.lower("brand")).alias("slug"))
    return brand.slug_directory(p, _registry(spark, d))


@query(f"WITH {PRODUCTS}, {_REG}, pr AS (SELECT id, CASE WHEN ord % 10 = 0 THEN name ELSE lower(brand) END AS slug, CASE WHEN ord % 20 = 0 THEN '' ELSE brand END AS brand FROM products) SELECT id, coalesce(kr, nullif(brand, ''), pr.slug) AS local_name, coalesce(en, upper(pr.slug)) AS english_name FROM pr LEFT JOIN reg USING (slug)")
def brand_display(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d).select("id", F.when(F.col("ord") % 10 == 0, F.col("name")).otherwise(F.lower("brand")).alias("slug"), F.when(F.col("ord") % 20 == 0, F.lit("")).otherwise(F.col("brand")).alias("brand"))
    return brand.brand_display(p, _registry(spark, d)).select("id", "local_name", "english_name")


@query(f"""WITH {_CARDS} SELECT CAST(CASE grouping_id(c, s, sub) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS level, c AS category, s AS brand, sub, count(*) AS n FROM cards GROUP BY GROUPING SETS ((), (c), (c, s), (c, s, sub))""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facet_counts(cards(spark, d)).withColumn("level", F.col("level").cast("bigint"))


@query(f"WITH {_CARDS} SELECT c, count(DISTINCT s) AS brands FROM cards WHERE s NOT IN ('_misc', '_custom') GROUP BY c")
def brands_per_category(spark: SparkSession, d: str) -> DataFrame:
    return catalog.brands_per_category(cards(spark, d))


@query(f"""WITH {_CARDS}, k AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{i + 1:02d}')" for i, c in enumerate([*R.TOP_ORDER, 't8']))}) AS k(c, no)) SELECT k.c, k.no, count(cards.id) AS n FROM k LEFT JOIN cards ON cards.c = k.c GROUP BY ALL""")
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    dimension = catalog.numbered(spark.createDataFrame([(c, i) for i, c in enumerate([*R.TOP_ORDER, "t8"])], "c string, place int"), "place").select("c", "no")
    counts = cards(spark, d).groupBy("c").agg(F.count("*").alias("n"))
    return catalog.zero_filled(counts, dimension, "c", "n").select("c", "no", "n")


@query(f"""WITH {_CARDS}, {_DISPLAY}, w AS (SELECT cards.*, b FROM cards JOIN disp ON disp.s = cards.s), x AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_ORDER}) AS pos, lag(sub) OVER (PARTITION BY c ORDER BY {_ORDER}) AS before, count(*) OVER (PARTITION BY c) AS total FROM w)
    SELECT c, id, pos, (pos - 1) // 60 AS page, total - pos AS remaining, before IS DISTINCT FROM sub OR pos = 1 AS header FROM x""")
def paged_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.paged_by(shown(spark, d), ["c"], catalog.catalogue_order(R.TOP_ORDER), "sub")
    return rows.select("c", "id", F.col("pos").cast("bigint").alias("pos"), F.col("page").cast("bigint").alias("page"), "remaining", "header")


@query(f"WITH {_CARDS} SELECT id, n, p FROM cards WHERE c = 't2' AND s = '_misc' AND sub = 'c2'")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facet_filter(cards(spark, d), "t2", "_misc", "c2").select("id", "n", "p")


@query(f"WITH {_CARDS} SELECT id, count(*) OVER (PARTITION BY c, sub) AS n_1, count(*) OVER (PARTITION BY c, sub, n) AS n_2 FROM cards")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_group_counts(cards(spark, d), ["c", "sub"], ["c", "sub", "n"]).select("id", "n_1", "n_2")


@query(f"WITH {_CARDS} SELECT c, row_number() OVER (ORDER BY CASE c WHEN 't4' THEN 1 WHEN 't2' THEN 2 ELSE 3 END, f) AS rank FROM (SELECT c, min(ord) AS f FROM cards GROUP BY c)")
def category_ranks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unseen_category_rank(cards(spark, d), "c", ["t4", "t2"], "ord").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {PRODUCTS} SELECT brand, id, price FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY price DESC, id) AS rn FROM products) WHERE rn <= 3")
def top_per_brand(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top_n(products(spark, d), ["brand"], [F.desc("price"), "id"], 3).select("brand", "id", "price")


@query(f"WITH {PRODUCTS} SELECT id, name FROM products WHERE NOT regexp_matches(name, 'anvil|rod')")
def skipped_categories(spark: SparkSession, d: str) -> DataFrame:
    return catalog.skip_names(products(spark, d), "name", "anvil|rod").select("id", "name")


_BATCHES = """a AS (SELECT 'o' || o_custkey % 20 AS brand_slug, 'k' || o_custkey AS id, 'A' || o_custkey % 20 AS brand, max(o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
    b AS (SELECT 'o' || o_custkey % 20 AS brand_slug, 'k' || o_custkey AS id, CASE WHEN o_custkey % 20 = 3 THEN '' ELSE 'B' || o_custkey % 20 END AS brand, max(o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 20 < 15 GROUP BY ALL)"""


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").withColumn("g", F.col("o_custkey") % 20)

    def one(rows: DataFrame, name: Column) -> DataFrame:
        return rows.groupBy(F.concat(F.lit("o"), F.col("g").cast("string")).alias("brand_slug"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("id"), name.alias("brand")).agg(F.max("o_orderkey").alias("seq"))

    new = F.when(F.col("g") == 3, F.lit("")).otherwise(F.concat(F.lit("B"), F.col("g").cast("string")))
    return one(o.where("o_orderkey % 2 = 0"), F.concat(F.lit("A"), F.col("g").cast("string"))), one(o.where("o_orderkey % 2 = 1 and g < 15"), new)


def _upsert_sql(head: str, order: str) -> str:
    return f"""WITH {_BATCHES}, u AS (SELECT *, 0 AS bt FROM a UNION ALL SELECT *, 1 FROM b), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_slug, id ORDER BY {order} bt DESC) AS rn FROM u) WHERE rn = 1),
    h AS (SELECT brand_slug, max(CASE WHEN bt = 0 THEN nullif(brand, '') END) AS o, max(CASE WHEN bt = 1 THEN nullif(brand, '') END) AS n FROM u GROUP BY 1)
    SELECT brand_slug, id, brand, seq, {head} AS pack_brand_text FROM k JOIN h USING (brand_slug)"""


@query(_upsert_sql("coalesce(n, o)", ""))
def upsert_packs(spark: SparkSession, d: str) -> DataFrame:
    return sinks.upsert(*_batches(spark, d)).select("brand_slug", "id", "brand", "seq", "pack_brand_text")


@query(_upsert_sql("coalesce(o, n)", "seq DESC,"))
def upsert_refusing_late(spark: SparkSession, d: str) -> DataFrame:
    return sinks.upsert(*_batches(spark, d), header_policy="old", sequence="seq").select("brand_slug", "id", "brand", "seq", "pack_brand_text")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return packs.first_seen(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def _pictured(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d)
    none = F.array().cast("array<string>")
    u = lambda x: F.concat(F.lit(f"m/_misc/{x}"), "id")
    images = F.struct(
        F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(u("t")).alias("thumb"), F.when(F.col("ord") % 3 == 2, F.array(u("a"), u("b"))).otherwise(none).alias("main"),
        F.when(F.col("ord") % 2 == 0, F.array(u("d"), u("e"))).otherwise(none).alias("detail"),
    )
    return p.select("id", "name", "ord", F.lit("_misc").alias("brand_slug"), F.col("category").alias("source"), images.alias("images"), F.when(F.col("ord") % 7 == 0, F.lit(0)).otherwise(F.col("price")).alias("price"), F.when(F.col("ord") % 5 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("category")).alias("cat_path"))


@query(f"WITH {PRODUCTS} SELECT category AS source, count(*) FILTER (WHERE ord % 3 = 0 AND ord % 2 = 0) AS fixed, count(*) FILTER (WHERE ord % 3 = 0 AND ord % 2 = 1) AS missing FROM products GROUP BY 1")
def promoted_thumbs(spark: SparkSession, d: str) -> DataFrame:
    return quality.thumb_report(quality.promote_thumbs(_pictured(spark, d)))


@query(f"WITH {PRODUCTS} SELECT category AS source, count(*) AS n_rows, count(*) FILTER (WHERE ord % 3 = 0) AS no_image, count(*) FILTER (WHERE ord % 7 = 0) AS no_price, count(*) FILTER (WHERE ord % 5 = 0) AS no_path FROM products GROUP BY 1")
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_profile(_pictured(spark, d))


@query(f"""WITH {PRODUCTS}, x AS (SELECT id, 'thumb' AS kind, 1 AS n, 'm/_misc/t' || id AS src, 'thumb' AS nm, 600 AS w FROM products WHERE ord % 3 <> 0 UNION ALL SELECT id, 'main', i, 'm/_misc/' || CASE i WHEN 1 THEN 'a' ELSE 'b' END || id, 'main' || i, 1600 FROM products, (VALUES (1), (2)) v(i) WHERE ord % 3 = 2
    UNION ALL SELECT id, 'detail', i, 'm/_misc/' || CASE i WHEN 1 THEN 'd' ELSE 'e' END || id, 'detail0' || i, 1400 FROM products, (VALUES (1), (2)) v(i) WHERE ord % 2 = 0)
    SELECT id, kind, CAST(n AS BIGINT) AS n, src, 'products/_misc/' || id || '/' || nm || '.webp' AS key, CAST(w AS BIGINT) AS max_width FROM x WHERE NOT (nm = 'thumb' AND id IN (SELECT id FROM products WHERE ord % 4 = 1))""")
def image_plan(spark: SparkSession, d: str) -> DataFrame:
    p = _pictured(spark, d)
    stored = p.where("ord % 4 = 1").select(F.concat(F.lit("products/_misc/"), "id", F.lit("/thumb.webp")).alias("key"))
    return quality.image_plan(p, stored=stored).select("id", "kind", F.col("n").cast("bigint").alias("n"), "src", "key", F.col("max_width").cast("bigint").alias("max_width"))


@query(f"""WITH {PRODUCTS}, x AS (SELECT id, ord, {_BRAND} AS slug FROM products) SELECT id, slug AS brand_slug, slug <> '_misc' AS moved, CASE WHEN ord % 3 = 0 THEN '' ELSE 'm/' || slug || '/t' || id END AS thumb FROM x""")
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    p = _pictured(spark, d)
    resolved = p.select("id", brand.brand_fold(F.col("name"), R.BRANDS).alias("slug"))
    return quality.reclassify(p, resolved)[0].select("id", "brand_slug", "moved", F.col("images.thumb").alias("thumb"))


@query(f"WITH {PRODUCTS}, x AS (SELECT {_CLASS} AS cls FROM products) SELECT count(*) AS n, count(*) FILTER (WHERE cls IN ('c9', 'c5')) AS n_other, round(avg(CASE WHEN cls IN ('c9', 'c5') THEN 1.0 ELSE 0.0 END), 9) AS share FROM x")
def catch_all_share(spark: SparkSession, d: str) -> DataFrame:
    found = quality.catch_all_share(products(spark, d).withColumn("cls", _class()), "cls", ["c9", "c5"])
    return found.withColumn("share", F.round("share", 9))


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return quality.batch_totals(products(spark, d), "brand")
