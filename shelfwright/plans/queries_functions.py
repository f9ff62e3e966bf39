"""Queries of scalar functions, of class and path rules and of orders that the other modules don't show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import catalog, classify, policy
from ..sources import pages as raw
from . import demo_rules as R
from .queries_catalog import _CARDS, _RANK, _REG, _case, _map, _registry, cards
from .registry import query
from .tables import PRODUCTS, products

_URLS = r"""u AS (SELECT id, CASE ord % 6 WHEN 0 THEN '../img/' || id WHEN 1 THEN 'http://https://h/' || id WHEN 2 THEN '//h/' || id WHEN 3 THEN '\a\' || id WHEN 4 THEN id || '/small/x.jpg' ELSE '' END AS u FROM products),
    w AS (SELECT id, u, replace(u, '\', '/') AS w, regexp_replace(replace(u, '\', '/'), '^https?:/*(https?://)', '\1') AS m FROM u)"""


def _url_sql(c: str, other: str, dots: str = "") -> str:
    return f"CASE WHEN {c} = '' THEN '' WHEN starts_with({c}, '//') THEN 'https:' || {c} WHEN starts_with({c}, '/') THEN 'http://b' || {c} {dots} WHEN starts_with({c}, 'http') THEN {c} ELSE {other} END"


_PLAIN = "'http://b/' || regexp_replace({c}, '^[./]+', '')"


@query(
    f"""WITH {PRODUCTS}, {_URLS} SELECT id, {_url_sql("w", _PLAIN.format(c="w"), "WHEN starts_with(w, '../') THEN 'http://b/' || regexp_replace(w, '^([.][.]/)+', '')")} AS dots, {_url_sql("m", _PLAIN.format(c="m"))} AS repaired,
    {_url_sql("w", "w")} AS strict, CASE WHEN u = '' THEN '' WHEN starts_with(u, 'http') THEN u ELSE 'https://cdn/' || u END AS cdn, regexp_replace(u, '/(small|tiny|medium)/', '/big/', 'g') AS full_size FROM w"""
)
def url_functions(spark: SparkSession, d: str) -> DataFrame:
    """P4b, P4c, P10."""
    case = F.col("ord") % 6
    u = F.when(case == 0, F.concat(F.lit("../img/"), "id")).when(case == 1, F.concat(F.lit("http://https://h/"), "id")).when(case == 2, F.concat(F.lit("//h/"), "id"))
    p = products(spark, d).withColumn("u", u.when(case == 3, F.concat(F.lit("\\a\\"), "id")).when(case == 4, F.concat("id", F.lit("/small/x.jpg"))).otherwise(F.lit("")))
    variants = [T.abs_url(F.lit("http://b"), F.col("u"), v).alias(n) for v, n in (("dots", "dots"), ("repair", "repaired"), ("strict", "strict"))]
    return p.select("id", *variants, T.cdn_url("https://cdn/", F.col("u")).alias("cdn"), T.full_size_image(F.col("u")).alias("full_size"))


@query(
    rf"""WITH {PRODUCTS}, a AS (SELECT id, CASE ord % 3 WHEN 0 THEN '[new]  ' || name || ' | shop' WHEN 1 THEN 'Shop: [sale] ' || name || ' ' || brand || ' ' || category || ' with a text that is long enough - shop' ELSE name || ' (end)' END AS t FROM products),
    b AS (SELECT id, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '^(Shop:)', '')), '(\(end\))$', '')) AS t FROM a),
    c AS (SELECT id, CASE WHEN length(t) > 60 THEN regexp_replace(t, '\s*[|\-]\s*[^|\-]*$', '') ELSE t END AS t FROM b)
    SELECT id, CASE WHEN length(t) > 30 THEN regexp_replace(t, '^\[[^\]]*\]\s*', '') ELSE t END AS title FROM c"""
)
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """P6."""
    case = F.col("ord") % 3
    long = F.concat(F.lit("Shop: [sale] "), "name", F.lit(" "), "brand", F.lit(" "), "category", F.lit(" with a text that is long enough - shop"))
    title = F.when(case == 0, F.concat(F.lit("[new]  "), "name", F.lit(" | shop"))).when(case == 1, long).otherwise(F.concat("name", F.lit(" (end)")))
    return products(spark, d).select("id", T.clean_title(title, "Shop:", r"\(end\)").alias("title"))


_IMAGES = """im AS (SELECT id, ord, CASE WHEN ord % 2 = 0 THEN ['a/' || ord || '/1.jpg', '', 'data:x', 'a/' || ord || '/1.jpg', 'b/7' || ord || '.png', 'x/Banner.gif', 'c/' || ord || '9.jpg'] ELSE ['b/7' || ord || '.png', 'x/Banner.gif', 'z/.jpg', ''] END AS xs FROM products),
    un AS (SELECT id, ord, [x FOR x, i IN xs IF x <> '' AND NOT starts_with(x, 'data:') AND list_position(xs, x) = i] AS u FROM im),
    ke AS (SELECT *, [x FOR x IN u IF NOT contains(lower(x), 'banner')] AS k FROM un),
    ow AS (SELECT *, [x FOR x IN k IF regexp_matches(x, '(^|[^0-9])' || ord || '([^0-9]|$)')] AS strict, [x FOR x IN k IF contains(x, CAST(ord AS VARCHAR))] AS loose FROM ke)"""


@query(
    f"""WITH {PRODUCTS}, {_IMAGES} SELECT id, array_to_string(u, ' ') AS uniq, array_to_string(k, ' ') AS kept, array_to_string(CASE WHEN len(strict) > 0 THEN strict ELSE loose END, ' ') AS own, array_to_string([x FOR x IN u IF x <> 'x/Banner.gif'], ' ') AS unblocked,
    CASE WHEN ord % 3 <> 0 THEN 'm1 m2' WHEN ord % 4 <> 0 THEN 't' ELSE '' END AS hero, CASE WHEN ord % 4 <> 0 THEN 't' WHEN ord % 3 <> 0 THEN 'm1' ELSE '' END AS thumb FROM ow"""
)
def image_lists(spark: SparkSession, d: str) -> DataFrame:
    """P8, P9, P10b, P25, F5."""
    num = F.col("ord").cast("string")
    part = lambda a, b: F.concat(F.lit(a), num, F.lit(b))
    even = F.array(part("a/", "/1.jpg"), F.lit(""), F.lit("data:x"), part("a/", "/1.jpg"), part("b/7", ".png"), F.lit("x/Banner.gif"), part("c/", "9.jpg"))
    p = products(spark, d).withColumn("u", T.ordered_uniq(F.when(F.col("ord") % 2 == 0, even).otherwise(F.array(part("b/7", ".png"), F.lit("x/Banner.gif"), F.lit("z/.jpg"), F.lit("")))))
    p = p.withColumn("k", T.drop_boilerplate_images(F.col("u"), "banner"))
    none = F.array().cast("array<string>")
    images = F.struct(F.when(F.col("ord") % 3 != 0, F.array(F.lit("m1"), F.lit("m2"))).otherwise(none).alias("main"), F.when(F.col("ord") % 4 != 0, F.lit("t")).otherwise(F.lit("")).alias("thumb"))
    hero = T.hero_image(images)
    joined = lambda c: F.array_join(c, " ")
    return p.select(
        "id", joined("u").alias("uniq"), joined("k").alias("kept"), joined(T.own_images(F.col("k"), num)).alias("own"), joined(policy.block_urls(F.col("u"), F.array(F.lit("x/Banner.gif")))).alias("unblocked"),
        joined(hero["main"]).alias("hero"), hero["thumb"].alias("thumb"),
    )


@query(
    f"""WITH {PRODUCTS}, e AS (SELECT *, CASE WHEN ord % 5 = 0 THEN '' ELSE category END AS cat FROM products) SELECT id, CASE WHEN ord % 3 < 2 THEN category ELSE coalesce(nullif(cat, ''), 'etc') END AS rest, CASE WHEN ord % 3 = 0 THEN upper(brand) ELSE '' END AS second,
    'src:' || CASE ord % 3 WHEN 0 THEN 'Shop/' || upper(brand) || '/' || category WHEN 1 THEN category || '/' ELSE brand END AS menu_code, CASE category WHEN 'promo' THEN 'P' WHEN 'economy' THEN 'E' ELSE brand END AS level,
    name || ', ' || brand || ', ' || category AS keywords FROM e"""
)
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """P18, P19, P24, C4, C10."""
    case = F.col("ord") % 3
    path = F.when(case == 0, F.array(F.lit("Shop"), F.upper("brand"), F.col("category"))).when(case == 1, F.array(F.col("category"), F.lit(""))).otherwise(F.array("brand"))
    cat = F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.col("category"))
    return products(spark, d).select(
        "id", F.array_join(T.path_after_brand(path, F.array("brand", F.lit("other")), cat, "etc"), "/").alias("rest"), T.nth_level(path, 2).alias("second"), classify.source_menu_code(path).alias("menu_code"),
        classify.level_name(F.col("category"), {"promo": "P", "economy": "E"}, F.col("brand")).alias("level"), T.meta_text(F.col("name"), F.col("brand"), F.array("category", "brand"), F.lit("x"))["keywords"].alias("keywords"),
    )


@query(
    f"""WITH {PRODUCTS} SELECT id, CASE WHEN ord % 4 = 0 THEN 0 WHEN ord % 4 = 1 THEN 450 ELSE price END AS last_price, CASE WHEN ord % 3 = 0 THEN price WHEN ord % 5 = 0 THEN 0 ELSE price - 1 END AS price,
    CASE WHEN ord % 5 = 0 THEN 0 ELSE price - 1 END AS sale_price, ord % 3 <> 0 AND ord % 5 = 0 AS inquiry FROM products"""
)
def price_texts(spark: SparkSession, d: str) -> DataFrame:
    """P11c, P11d: the last price of a page that is not zero; sale prices that a text takes back."""
    text = F.concat(F.format_number("price", 0), F.lit(" won"))
    values = F.when(F.col("ord") % 4 == 0, F.array(F.lit("0"), F.lit("12"))).when(F.col("ord") % 4 == 1, F.array(text, F.lit("450"), F.lit("000"))).otherwise(F.array(F.lit("900"), text, F.lit("0")))
    listed = F.when(F.col("ord") % 3 == 0, F.col("price")).otherwise(F.lit(0))
    policy = T.price_policy(listed, F.col("price") - 1, "phone_inquiry", F.when(F.col("ord") % 5 == 0, F.lit("please call us")).otherwise(F.lit("")))
    return products(spark, d).select("id", T.last_nonzero(values).alias("last_price"), policy["price"].alias("price"), policy["sale_price"].alias("sale_price"), policy["inquiry"].alias("inquiry"))


@query(f"WITH {PRODUCTS} SELECT id, CASE WHEN ord % 3 = 0 THEN price ELSE price + 7 END AS value FROM products WHERE ord % 3 < 2")
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    """P12. Rows of a detail table: the first label of the set with a value over 0."""
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    first = F.when(F.col("ord") % 3 == 0, F.format_number("price", 0)).otherwise(F.lit("0"))
    second = F.when(F.col("ord") % 3 < 2, F.concat((F.col("price") + 7).cast("string"), F.lit(" won"))).otherwise(F.lit("-"))
    rows = products(spark, d).select("id", F.posexplode(F.array(row("weight", F.lit("123456")), row("price", first), row("sale", second))).alias("pos", "x")).select("id", "pos", "x.label", "x.value")
    return raw.labelled_value(rows, ("price", "sale"))


_CINE = "ci AS (SELECT id, category, name || CASE ord % 4 WHEN 0 THEN ' 50mm T2.9' WHEN 1 THEN ' T 1.5 zoom lens' WHEN 2 THEN ' T2.9 cable' ELSE '' END AS name, ord FROM products)"


@query(f"WITH {PRODUCTS}, {_CINE} SELECT id, coalesce({_case('name', R.RULES[:2])}, CASE ord % 4 WHEN 0 THEN 'prime' WHEN 1 THEN 'zoom' END, {_map('category', R.HINTS)}, 'none') AS cls FROM ci")
def tstop_classes(spark: SparkSession, d: str) -> DataFrame:
    """C2 between the keywords and the hint."""
    case = F.col("ord") % 4
    end = F.when(case == 0, F.lit(" 50mm T2.9")).when(case == 1, F.lit(" T 1.5 zoom lens")).when(case == 2, F.lit(" T2.9 cable")).otherwise(F.lit(""))
    name = F.concat("name", end)
    rule = classify.tstop(name, ["zoom"], ["lens", "mm"], "zoom", "prime")
    return products(spark, d).select("id", classify.classify(name, F.col("category"), R.RULES[:2], R.HINTS, "none", rule).alias("cls"))


@query(f"WITH {PRODUCTS} SELECT id, {_case('name', R.RULES)} AS cls FROM products")
def matched_rules(spark: SparkSession, d: str) -> DataFrame:
    """C1 in the form that the number of keywords calls for."""
    return classify.match_rules(products(spark, d), "name", R.RULES, "cls").select("id", "cls")


_PRICE = "coalesce(nullif(CAST(p AS DOUBLE), 0), nullif(usd, 0), 0)"


@query(
    f"""WITH {_CARDS}, g AS (SELECT *, count(*) OVER (PARTITION BY s, c) AS n_1, count(*) OVER (PARTITION BY s, c, sub) AS n_2 FROM cards)
    SELECT id, row_number() OVER (ORDER BY {_RANK}, n_1 DESC, c, n_2 DESC, sub, {_PRICE} DESC, id) AS pos FROM g"""
)
def archived_order(spark: SparkSession, d: str) -> DataFrame:
    """O2. Places in the archived order, over the whole feed."""
    rows = catalog.with_group_counts(cards(spark, d), ["s", "c"], ["s", "c", "sub"])
    return catalog.paged(rows, catalog.archive_order(R.TOP_ORDER, ["s", "c"], ["s", "c", "sub"]), "sub").select("id", "pos")


@query(f"WITH {_REG} SELECT slug, row_number() OVER (ORDER BY en, slug) AS place FROM reg")
def brand_tiles(spark: SparkSession, d: str) -> DataFrame:
    """O3. Places of the brand tiles (a row a brand) in a locale's order; these names are ordered alike by their letters."""
    tiles = catalog.tiles(_registry(spark, d), "en")
    return tiles.select("slug", F.row_number().over(Window.orderBy(F.collate("en", "ko"), "slug")).cast("bigint").alias("place"))


@query(f"WITH {PRODUCTS}, o AS (SELECT CASE WHEN ord % 9 = 0 THEN '_' || lower(brand) ELSE lower(brand) END AS slug, CASE WHEN ord % 7 = 0 THEN 's1' WHEN ord % 4 = 0 THEN 's9' ELSE 's' || (3 + ord % 4) END AS source, id FROM products), "
       "ix AS (SELECT slug, list(DISTINCT source) AS sources FROM o GROUP BY slug) SELECT id, slug, source FROM o JOIN ix USING (slug) WHERE CASE WHEN slug = 'brand#3' THEN source = 's4' WHEN NOT starts_with(slug, '_') AND list_contains(sources, 's1') THEN source = 's1' WHEN source = 's9' THEN len(sources) = 1 ELSE true END")  # fmt: skip
def policy_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """F2, J1. The source policy over brand slugs; slugs with a leading underscore are no real brands."""
    source = F.when(F.col("ord") % 7 == 0, F.lit("s1")).when(F.col("ord") % 4 == 0, F.lit("s9")).otherwise(F.concat(F.lit("s"), (3 + F.col("ord") % 4).cast("string")))
    slug = F.when(F.col("ord") % 9 == 0, F.concat(F.lit("_"), F.lower("brand"))).otherwise(F.lower("brand"))
    rows = products(spark, d).select("id", slug.alias("slug"), source.alias("source"))
    return policy.with_policy(rows, ["s1"], "s9", {"brand#3": "s4"}).select("id", "slug", "source")
