"""Raw pages as a source: links of listing pages, category menus, breadcrumbs and product drafts, by pattern tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import abs_url, clean_text_html, drop_boilerplate_images, img_src, ordered_uniq, present, price_num, price_policy, unescape

LINK = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def text_of(fragment: Column) -> Column:
    """Text of an HTML fragment: tags out, entities decoded, white space as one space."""
    return clean_text_html(F.regexp_replace(fragment, r"(?s)<[^>]*>", ""))


def links(pages: DataFrame, inside: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All links of each page in order: (keep..., pos, href, label). `inside`: a pattern whose group 1 is the part to look in."""
    part = F.regexp_extract("html", inside, 1) if inside else F.col("html")
    href, label = F.regexp_extract_all(part, F.lit(LINK), F.lit(1)), F.regexp_extract_all(part, F.lit(LINK), F.lit(2))
    rows = pages.select(*keep, F.posexplode(F.arrays_zip(href.alias("href"), label.alias("label"))).alias("pos", "x"))
    return rows.select(*keep, "pos", unescape(F.col("x.href")).alias("href"), text_of(F.col("x.label")).alias("label"))


def extract_listing(pages: DataFrame, rules: DataFrame, inside: str | None = None, at: Column | None = None) -> DataFrame:
    """S2. Item links on listing pages: (site, cat, page_no, pos, sid, url), first seen in each category.

    rules: (site, base, sid_pattern) - a row a site; group 1 of the pattern is the item's id. `inside` as in links; `at` is added to the
    links' places, where several pages share a number.
    """
    pages = pages.withColumn("_at", F.lit(0) if at is None else at)
    found = links(pages, inside, ("site", "cat", "page_no", "_at")).withColumn("pos", F.col("_at") + F.col("pos")).join(rules, "site")
    found = found.withColumn("sid", F.expr("regexp_extract(href, sid_pattern, 1)"))
    found = found.where("sid <> ''").withColumn("url", abs_url(F.col("base"), F.col("href")))
    first = Window.partitionBy("site", "cat", "sid").orderBy("page_no", "pos")
    return found.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("site", "cat", "page_no", "pos", "sid", "url")


def new_per_page(pages: DataFrame, items: DataFrame) -> DataFrame:
    """W8. Pages of each category before the first one without a new id: (site, cat, page_no, n_new). Later pages
    don't count, even if they hold new ids."""
    found = pages.select("site", "cat", "page_no").distinct().join(items.groupBy("site", "cat", "page_no").agg(F.count("*").alias("n_new")), ["site", "cat", "page_no"], "left").fillna(0, ["n_new"])
    stop = F.min(F.when(F.col("n_new") == 0, F.col("page_no"))).over(Window.partitionBy("site", "cat"))
    return found.withColumn("stop", stop).where("stop is null or page_no < stop").drop("stop")


def extract_nav(menu_links: DataFrame, code_pattern: str) -> DataFrame:
    """S4. (site, code, name) of a menu's links: the first name of two characters or more that is not only digits and
    signs; a code without such a name is its own name."""
    codes = menu_links.withColumn("code", F.regexp_extract("href", code_pattern, 1)).where("code <> ''")
    good = (F.length("label") >= 2) & F.col("label").rlike(r"\p{L}")
    best = Window.partitionBy("site", "code").orderBy(F.when(good, 0).otherwise(1), "ord", "pos")
    return codes.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("site", "code", F.when(good, F.col("label")).otherwise(F.col("code")).alias("name"))


def extract_breadcrumb(pages: DataFrame, candidates: list[str], home: tuple[str, ...] = ("Home", "HOME", ">"), heading: str = r"(?is)<h[12][^>]*>(.*?)</h[12]>") -> DataFrame:
    """S11. (site, code, path): the first pattern whose matches yield names, home words dropped; else the page's heading;
    else the category's own name."""
    names = lambda p: F.filter(F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), text_of), lambda x: (x != "") & ~x.isin(*home))
    found = [F.when(F.size(names(p)) > 0, names(p)) for p in candidates]
    title = present(text_of(F.regexp_extract("html", heading, 1)))
    return pages.select("site", "code", F.coalesce(*found, F.when(title.isNotNull(), F.array(title)), F.array(F.col("name"))).alias("path"))


def extract_detail(pages: DataFrame, name: list[str], listed: list[str], sale: list[str], base: str, boilerplate: str = "banner|notice|delivery") -> DataFrame:
    """S3. A product draft of each page: the first pattern of each list that finds something; images absolute, once each, no
    boilerplate."""
    first = lambda ps, f: F.coalesce(*[f(F.regexp_extract("html", p, 1)) for p in ps])
    price = lambda p: F.when(price_num(text_of(p)) > 0, price_num(text_of(p)))
    policy = price_policy(first(listed, price), first(sale, price))
    images = drop_boilerplate_images(ordered_uniq(F.transform(ordered_uniq(img_src(F.col("html"))), lambda u: abs_url(F.lit(base), u))), boilerplate)
    return pages.select("site", "sid", F.coalesce(first(name, lambda x: present(text_of(x))), F.lit("")).alias("name"), policy.alias("p"), images.alias("images")).select("site", "sid", "name", "p.*", "images")


def labelled_value(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """P12. For each id the first value over 0 of a row whose label is in the set: rows (id, pos, label, value)."""
    good = rows.withColumn("n", price_num(F.col("value"))).where(F.col("label").isin(*labels) & (F.col("n") > 0))
    return good.groupBy("id").agg(F.min_by("n", "pos").alias("value"))


def parse_with(pages: DataFrame, parser: Callable, schema: str) -> DataFrame:
    """X2. A hook for a site whose pages no pattern can read: `parser` maps an iterator of pandas frames to another."""
    return pages.mapInPandas(parser, schema)
