"""Ordered first-match classification. Rules are data: (priority, out, keywords)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Above so many keywords in all, rules are joined instead of folded into an expression (whose code then grows too long to be compiled); rule tables are
#: broadcast up to RULES_MOST rows with BYTES_MOST bytes of text (what Spark itself would broadcast by default), larger ones are shuffled.
FOLD_KEYWORDS, RULES_MOST, BYTES_MOST = 3_000, 200_000, 10 << 20
#: Lengths of the grams by which keywords are looked up: the greatest that a keyword has, so that up to 31 code points every gram is more than half of it.
GRAMS = (1, 2, 4, 8, 16)

Rules = list[tuple[str, list[str]]]


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, taken literally."""
    return "|".join(re.escape(w.lower()).replace("\\ ", " ") for w in words)


def first_match(text: Column, rules: Rules) -> Column:
    """C1 as an expression: output of the first rule with a keyword in the lower-cased text, else null. Later rules are not
    evaluated."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(t.rlike(any_of(words)), F.lit(out)) for out, words in rules], F.lit(None).cast("string"))


def rule_table(spark, rules: Rules) -> DataFrame:
    """(priority, out, keyword), keywords lower-cased."""
    rows = [(i, out, w.lower()) for i, (out, words) in enumerate(rules) for w in words]
    return spark.createDataFrame(rows, "priority int, out string, keyword string")


def small(rules: DataFrame) -> DataFrame:
    """A rule table, to be broadcast if it has at most RULES_MOST rows and BYTES_MOST bytes of text, since few rules can be long ones. A larger one is joined by
    sorting both sides: what is exploded on the other side has many times the size that its files let Spark expect, so that is never broadcast either."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c, kind in rules.dtypes if kind == "string"]
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(rules) if n <= RULES_MOST and size <= BYTES_MOST else rules.hint("merge")


def grams(text: Column, n: int) -> Column:
    """The distinct stretches of n code points of a text. They are read off n times, from n places in a row, so that time is in proportion to length."""
    at = lambda k: F.regexp_extract_all(F.substr(text, F.lit(k + 1)) if k else text, F.lit(f"(?s).{{{n}}}"), F.lit(0))
    return F.array_distinct(F.concat(*[at(k) for k in range(n)])) if n else F.array(F.lit(""))


def gram_length(keyword: Column) -> Column:
    """Length of the grams by which a keyword is looked up; 0 for the empty one, whose gram is in every text."""
    return F.coalesce(*[F.when(F.length(keyword) >= n, F.lit(n)) for n in sorted(GRAMS, reverse=True)], F.lit(0))


def gram_index(texts: DataFrame, rules: DataFrame, sizes: list[int]) -> DataFrame:
    """rules (.., keyword) with the column _gram: of the keyword's grams the one that is rarest in the texts (_t). Keywords with a gram that no text holds
    can't match and are left out. sizes: the lengths of the grams that the keywords have."""
    own = F.coalesce(*[F.when(gram_length(F.col("keyword")) == n, grams(F.col("keyword"), n)) for n in sizes])
    asked = rules.select("keyword").where("keyword is not null").distinct().withColumn("_gram", F.explode(own))
    counts = texts.select(F.explode(_all_grams(sizes)).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
    best = asked.join(counts.hint("merge"), "_gram", "left").groupBy("keyword").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    return rules.join(best.where("_n > 0").drop("_n").hint("merge"), "keyword")


def _all_grams(sizes: list[int]) -> Column:
    """The grams of these lengths of a lower-cased text (_t)."""
    return F.concat(F.array().cast("array<string>"), *[grams(F.lower("_t"), n) for n in sizes])


def keyword_hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each text (_t, ...) with each rule (..., keyword) whose keyword its lower-cased form holds. Texts and keywords meet by equality of a gram -
    the rarest of the keyword - and only such pairs are compared. Empty keywords are in every text. Both are read more than once."""
    sizes = sorted(r[0] for r in rules.where("keyword is not null").select(gram_length(F.col("keyword"))).distinct().collect())  # six at most
    index = small(staged(gram_index(texts, rules, sizes))) if sizes else rules.where("false").withColumn("_gram", F.lit(""))
    pairs = texts.withColumn("_gram", F.explode(_all_grams(sizes))).join(index, "_gram")
    return pairs.where(F.contains(F.lower("_t"), F.col("keyword"))).drop("_gram")


def match_rules(df: DataFrame, text: str, rules: Rules, name: str = "out") -> DataFrame:
    """C1 in the form that suits the number of keywords."""
    if sum(len(words) for _, words in rules) <= FOLD_KEYWORDS:
        return df.withColumn(name, first_match(F.col(text), rules))
    return first_match_join(df, text, rule_table(df.sparkSession, rules), name)


def first_match_join(df: DataFrame, text: str, rules: DataFrame, name: str = "out") -> DataFrame:
    """C1 as a join, for rule sets too large for an expression: each distinct text meets the keywords that share their rarest gram with it; the
    smallest priority wins. Same result as first_match: a null text counts as the empty one. Null keywords match nothing."""
    plain = F.coalesce(text, F.lit(""))
    texts = df.select(plain.alias("_t")).distinct()
    hits = keyword_hits(texts, staged(rules.select("priority", F.col("out").alias("_out"), "keyword").where("keyword is not null")))
    best = hits.groupBy("_t").agg(F.min_by("_out", "priority").alias(name))
    return df.join(best, plain == F.col("_t"), "left").drop("_t")


TSTOP = r"\bt\s?[0-9]\.[0-9]"


def tstop(text: Column, zoom: list[str], context: list[str], out_zoom: str, out_prime: str) -> Column:
    """C2. A T-stop number together with a lens word: zoom or prime, else null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(TSTOP) & t.rlike(any_of(context)), F.when(t.rlike(any_of(zoom)), F.lit(out_zoom)).otherwise(F.lit(out_prime)))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A small dictionary as a constant map (C3, J10)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def classify(name: Column, category: Column, rules: Rules, hints: dict[str, str], default: str, tstop_rule: Column | None = None) -> Column:
    """C1-C4. Keywords in the name, then the T-stop test, then the category hint, then the default."""
    hint = lookup(F.lower(F.trim(F.coalesce(category, F.lit("")))), hints)
    return F.coalesce(first_match(name, rules), *([tstop_rule] if tstop_rule is not None else []), hint, F.lit(default))


def level_name(code: Column, names: dict[str, str], other: Column) -> Column:
    """C4. Name of a level-2 code, else the level-1 class's 'other' name."""
    return F.coalesce(lookup(code, names), other)


def from_code(code: Column, fixes: dict[str, str], known: list[str], by_name: Column, refine: tuple[str, str] | None = None) -> Column:
    """C5, J11. A trusted code, cut to four characters and mended, if it is known; else the class by name. refine (a, b): code a is
    replaced where the name says b, and by nothing else."""
    short = F.substring(code, 1, 4)
    mended = F.coalesce(lookup(short, fixes), short)
    good = mended.isin(*known) & (code != "")
    out = F.when(good, mended)
    if refine:
        out = F.when(good & (mended == refine[0]) & (by_name == refine[1]), F.lit(refine[1])).when(good, mended)
    return F.coalesce(out, by_name)


def top_category(name: Column, level1: Column, level2: Column, first: Rules, by_level2: dict[str, str], by_level1: dict[str, str], default: str) -> Column:
    """C7. Keyword groups, then the level-2 and the level-1 mapping, then the default."""
    return F.coalesce(first_match(name, first), lookup(level2, by_level2), lookup(level1, by_level1), F.lit(default))


def resolve_top(slug: Column, by_brand: dict[str, str], by_rules: Column, pseudo: tuple[str, ...] = ("_misc", "_custom")) -> Column:
    """C8, J10. A real brand's category where it is listed, else the rules'."""
    return F.coalesce(F.when(~slug.isin(*pseudo), lookup(slug, by_brand)), by_rules)


def two_stage(name: Column, category: Column, lines: Rules, cameras: Rules, generic: tuple[str, ...] = ("special deals", "")) -> Column:
    """C6. struct<group, key>: a clean leaf by product lines and then cameras; else the name by cameras and then lines, as a deal;
    else etc. The stages use the rules in opposite order, and a clean leaf without a match goes to the second."""
    leaf = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    clean = ~leaf.isin(*generic)
    l1, c1, c2, l2 = first_match(leaf, lines), first_match(leaf, cameras), first_match(name, cameras), first_match(name, lines)
    group = F.when(clean & l1.isNotNull(), "prod").when(clean & c1.isNotNull(), "cam").otherwise("deal")
    key = F.when(clean & l1.isNotNull(), l1).when(clean & c1.isNotNull(), c1).otherwise(F.coalesce(c2, l2, F.lit("etc")))
    return F.struct(group.alias("group"), key.alias("key"))


def display_path(levels: list[Column], category: Column, default: str) -> Column:
    """C9, C10. The level names that are not empty; if there are none the category, else the default."""
    named = F.filter(F.array(*levels), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.coalesce(F.when(category != "", category), F.lit(default))))


def source_menu_code(path: Column) -> Column:
    """C10. Synthetic menu code of a source's own tree."""
    return F.concat(F.lit("src:"), F.array_join(path, "/"))


def rule_audit(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """C12. (priority, hits, first_hits) of every rule: rows it matches, and rows it is the first to match. A rule with hits and no
    first_hits is shadowed."""
    texts, rules = df.groupBy(F.col(text).alias("_t")).agg(F.count("*").alias("_n")), staged(rules.select("priority", "keyword"))
    hits = keyword_hits(texts, rules).groupBy("_t", "_n").agg(F.collect_set("priority").alias("_all"), F.min("priority").alias("_first"))
    counted = hits.select("_n", "_first", F.explode("_all").alias("priority")).groupBy("priority").agg(F.sum("_n").alias("hits"), F.sum(F.when(F.col("priority") == F.col("_first"), F.col("_n")).otherwise(0)).alias("first_hits"))
    return rules.select("priority").distinct().join(counted, "priority", "left").fillna(0, ["hits", "first_hits"])


def dead_rules(rules: DataFrame) -> DataFrame:
    """C12 without data. (priority, earlier): rules that can never win, since each of their keywords holds a keyword of an earlier rule - wherever it stands, the
    earlier one stands too. earlier: the first such rule. Keywords are taken as texts of the gram join, so no two are compared without cause."""
    known = staged(rules.where("keyword is not null").select("priority", "keyword").distinct())
    held = keyword_hits(known.select(F.col("keyword").alias("_t")).distinct(), known.select(F.col("priority").alias("_by"), "keyword")).groupBy(F.col("_t").alias("keyword")).agg(F.min("_by").alias("_by"))
    found = known.join(held.hint("merge"), "keyword")  # each keyword holds itself
    return found.groupBy("priority").agg(F.bool_and(F.col("_by") < F.col("priority")).alias("_dead"), F.min("_by").alias("earlier")).where("_dead").select("priority", "earlier")
