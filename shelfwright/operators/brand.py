"""Brand resolution and the brand registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_nonempty, lead_tags, present, strip_lead_tags
from .classify import small


def brand_fold(name: Column, rules: list[tuple[str, str]], default: str = "_misc") -> Column:
    """J9. Slug of the first rule (prefix, slug) that the name begins with - as it is or without blanks; else of the first
    leading [tag] that equals or begins with a rule's prefix, in any case; else the default."""
    n = strip_lead_tags(name)
    nn = F.replace(n, F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    by_name = F.coalesce(*[F.when(F.startswith(n, F.lit(p)) | F.startswith(nn, F.lit(p.replace(" ", ""))), F.lit(s)) for p, s in rules], out)
    tag = lambda t: F.coalesce(*[F.when(F.startswith(F.upper(F.replace(t, F.lit(" "), F.lit(""))), F.lit(p.replace(" ", "").upper())), F.lit(s)) for p, s in rules], out)
    by_tag = F.try_element_at(F.filter(F.transform(lead_tags(name), tag), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(by_name, by_tag, F.lit(default))


def resolve_brands(products: DataFrame, rules: DataFrame, name: str = "name", key: str = "id", default: str = "_misc") -> DataFrame:
    """J9 for rules as a table (priority, prefix, slug). Names are cut at the lengths that prefixes have, and the pieces meet the prefixes by equality:
    the name's, then those of the name without blanks, then the tags'. Distinct names are matched, so a name is tested once however
    often it occurs, and no row is lost. Rules without a prefix match nothing."""
    names = products.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    n = strip_lead_tags(F.col("_name"))
    blank = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    squeezed = blank(F.col("prefix"))
    forms = {"n": F.col("prefix"), "q": squeezed, "t": F.upper(squeezed)}
    table = rules.where("prefix is not null").select("priority", "slug", F.explode(F.array(*[F.struct(F.lit(k).alias("_form"), v.alias("_piece")) for k, v in forms.items()])).alias("_r")).select("priority", "slug", "_r.*").distinct()
    table = small(table)
    lengths = {k: [] for k in forms}
    for r in table.select("_form", F.length("_piece").alias("n")).distinct().collect():  # no more rows than the longest prefix is long, times three
        lengths[r["_form"]].append(r["n"])

    def pieces(form: str, text: Column, pos: Column) -> Column:
        """(_form, _pos, _piece) of a text cut at the lengths of a form's prefixes."""
        cuts = F.filter(F.array(*[F.lit(x) for x in sorted(lengths[form])]).cast("array<int>"), lambda x: x <= F.length(text))
        return F.transform(cuts, lambda x: F.struct(F.lit(form).alias("_form"), pos.cast("int").alias("_pos"), F.substring(text, F.lit(1), x).alias("_piece")))

    tags = F.flatten(F.transform(lead_tags(F.col("_name")), lambda t, i: pieces("t", F.upper(blank(t)), i + 1)))
    cut = names.select("_name", F.explode(F.concat(pieces("n", n, F.lit(0)), pieces("q", blank(n), F.lit(0)), tags)).alias("_c")).select("_name", "_c.*")
    found = cut.join(table, ["_form", "_piece"]).groupBy("_name").agg(F.min_by("slug", F.struct("_pos", "priority")).alias("slug"))
    return products.join(found, F.col(name) == F.col("_name"), "left").drop("_name").withColumn("slug", F.coalesce("slug", F.lit(default)))


def is_real(slug: Column, pseudo: tuple[str, ...] = ("_misc", "_custom")) -> Column:
    """F8."""
    return ~slug.isin(*pseudo)


def pack_counts(products: DataFrame, aliases: dict[str, str] | None = None, stem: str = "file_stem") -> DataFrame:
    """A2. Products of each pack, aliases merged: (slug, count)."""
    slug = F.col(stem)
    if aliases:
        slug = reduce(lambda acc, kv: acc.when(F.col(stem) == kv[0], F.lit(kv[1])), list(aliases.items())[1:], F.when(F.col(stem) == list(aliases)[0], F.lit(list(aliases.values())[0]))).otherwise(F.col(stem))
    return products.groupBy(slug.alias("slug")).agg(F.count("*").alias("count"))


def display_names(products: DataFrame, slug: str, name: str, order: list[str], pseudo: tuple[str, ...] = ("_misc", "_custom"), label: str = "etc") -> DataFrame:
    """A3. (slug, display): the name most products of the brand bear, of equals the one seen first; pseudo brands have one label."""
    counts = products.groupBy(slug, F.coalesce(present(F.col(name)), F.col(slug)).alias("_n")).agg(F.count("*").alias("_c"), F.min(F.struct(*order)).alias("_first"))
    best = Window.partitionBy(slug).orderBy(F.desc("_c"), "_first")
    top = counts.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    return top.select(F.col(slug).alias("slug"), F.when(is_real(F.col(slug), pseudo), F.col("_n")).otherwise(F.lit(label)).alias("display"))


def brand_images(products: DataFrame, slug: str, thumb: str, order: list[str]) -> DataFrame:
    """A4. (slug, image): the first thumbnail that is not empty, in load order."""
    return products.where(present(F.col(thumb)).isNotNull()).groupBy(F.col(slug).alias("slug")).agg(F.min_by(thumb, F.struct(*order)).alias("image"))


def registry(lists: list[tuple[str, DataFrame]], counts: DataFrame) -> DataFrame:
    """U1, J15. Union of brand lists (flag, (slug, kr, en)) and of the counted packs: the first list's names win, a missing
    local name (empty or the slug) is taken from the next; flags are or-ed; count 0 where nothing was counted."""
    rows = None
    for i, (flag, df) in enumerate([*lists, ("in_scrape", counts.select("slug", F.lit(None).cast("string").alias("kr"), F.upper("slug").alias("en")))]):
        part = df.select("slug", "kr", "en", F.lit(i).alias("ord"), F.lit(flag).alias("flag"))
        rows = part if rows is None else rows.unionByName(part)
    named = F.when((F.coalesce("kr", F.lit("")) != "") & (F.col("kr") != F.col("slug")), F.col("kr"))
    flags = [F.bool_or(F.col("flag") == f).alias(f) for f, _ in lists] + [F.bool_or(F.col("flag") == "in_scrape").alias("in_scrape")]
    merged = rows.groupBy("slug").agg(F.min_by(named, F.when(named.isNotNull(), F.col("ord"))).alias("kr"), F.min_by("en", "ord").alias("en"), *flags)
    return merged.join(counts, "slug", "left").select("slug", F.coalesce("kr", "slug").alias("kr"), "en", *[f for f, _ in lists], "in_scrape", F.coalesce("count", F.lit(0)).alias("count"))


def overlap(reg: DataFrame, a: str, b: str) -> DataFrame:
    """U2, U3. Registry rows by side: 'both', 'only_<a>', 'only_<b>'."""
    side = F.when(F.col(a) & F.col(b), "both").when(F.col(a), f"only_{a}").when(F.col(b), f"only_{b}")
    return reg.withColumn("side", side).where("side is not null")


def slug_directory(products: DataFrame, reg: DataFrame) -> DataFrame:
    """U4. Slugs with products or in the registry: (slug, count, kr, en)."""
    slugs = products.select("slug").union(reg.select("slug")).distinct()
    n = products.groupBy("slug").agg(F.count("*").alias("n"))
    return slugs.join(n, "slug", "left").join(reg.select("slug", "kr", "en"), "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("kr", "slug").alias("kr"), F.coalesce("en", "slug").alias("en"))


def brand_display(products: DataFrame, reg: DataFrame) -> DataFrame:
    """P28, J14. Local and English name of each product's brand, the registry's first, then the record's, then the slug."""
    r = reg.select("slug", F.col("kr").alias("_kr"), F.col("en").alias("_en"))
    local = first_nonempty(F.col("_kr"), F.col("brand"), F.col("slug"))
    return products.join(r, "slug", "left").withColumn("local_name", local).withColumn("english_name", first_nonempty(F.col("_en"), F.upper("slug"))).drop("_kr", "_en")


def search(brands: DataFrame, text: str, have_only: bool = False) -> DataFrame:
    """F7. Brands whose English name, local name or slug holds the text, in any case."""
    q = text.lower()
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(q)) for c in ("en", "kr", "slug")])
    return brands.where(hit & ((F.col("count") > 0) if have_only else F.lit(True)))
