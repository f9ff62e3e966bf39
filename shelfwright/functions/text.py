"""Scalar functions on names, numbers, URLs and lists: Column -> Column, built-in expressions only."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A character reference: by number, by name; the closing ';' may be missing.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers that stand for another character (C1 controls as in windows-1252), and those that stand for none.
MENDED = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
NOTHING = {*range(1, 9), 0xB, *range(0xE, 0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0), *[0x10000 * k + x for k in range(17) for x in (0xFFFE, 0xFFFF)]} - set(MENDED)


def present(c: Column) -> Column:
    """null for an empty text: empty counts as missing everywhere."""
    return F.when(c != "", c)


def first_nonempty(*cs: Column) -> Column:
    """P29. The first text that is not empty, else ''."""
    return F.coalesce(*[present(c) for c in cs], F.lit(""))


def clean_text(c: Column) -> Column:
    """P1. Trimmed, with runs of (Unicode) white space as one space; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _table(pairs: dict[str, str]) -> Column:
    """A constant map of texts, made by the optimizer from one literal."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


#: Names that most references have; the table of all names is looked through for others only.
USUAL = {f"{k};": html5[f"{k};"] for k in ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "hellip", "middot", "ndash", "mdash")}
#: Length of the longest name that may stand without ';', and be followed by anything.
LOOSE = max(len(k) for k in html5 if not k.endswith(";"))


def _referred(ref: Column) -> Column:
    """The text that one character reference stands for; itself if it stands for none."""
    name = F.substring(ref, 2, 40)
    cuts = F.array(F.length(name), *[F.lit(n) for n in range(LOOSE, 1, -1)])
    found = F.transform(cuts, lambda n: F.struct(F.try_element_at(_table(dict(html5)), F.substring(name, F.lit(1), n)).alias("v"), n.alias("n")))
    longest = F.get(F.transform(F.filter(found, lambda x: x["v"].isNotNull()), lambda x: F.concat(x["v"], F.substring(name, x["n"] + 1, F.lit(40)))), F.lit(0))
    named = F.coalesce(F.try_element_at(_table(USUAL), name), longest, ref)
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]+)", 1)
    number = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    number = F.when(F.length(digits) > 9, F.lit(0x110000).cast("bigint")).otherwise(number)
    bad = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    counted = F.coalesce(F.try_element_at(_table({str(k): v for k, v in MENDED.items()} | {str(k): "" for k in NOTHING}), number.cast("string")), F.when(bad, F.lit("\ufffd")).otherwise(letter))
    return F.when(F.startswith(ref, F.lit("&#")), counted).otherwise(named)


def unescape(c: Column) -> Column:
    """X3 as an expression: every named and numbered character reference decoded. Texts without '&' are left alone."""
    gaps, refs = F.split(c, REFERENCE, -1), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    parts = F.zip_with(gaps, F.transform(refs, _referred), lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def clean_text_html(c: Column) -> Column:
    """P2. clean_text after decoding all character references."""
    return clean_text(unescape(F.coalesce(c, F.lit(""))))


@F.pandas_udf(StringType())
def unescape_all(s: pd.Series) -> pd.Series:
    """X3. The same as unescape, by the standard library on Arrow batches."""
    return s.map(html.unescape, na_action="ignore")


def price_num(c: Column) -> Column:
    """P3. The first run of three or more digits and commas as a number, else 0."""
    run = F.replace(F.regexp_extract(clean_text(c), "[0-9,]{3,}", 0), F.lit(","), F.lit(""))
    return F.coalesce(present(run).try_cast("bigint"), F.lit(0).cast("bigint"))


def abs_url(base: Column, u: Column, variant: str = "plain") -> Column:
    """P4. Absolute URL. Variants: plain; dots ('../' is the site's root); repair (a doubled scheme is mended);
    strict (nothing but '//', '/' and absolute forms: relative ones stay as they are)."""
    u = F.replace(F.coalesce(u, F.lit("")), F.lit("\\"), F.lit("/"))
    if variant == "repair":
        u = F.regexp_replace(u, r"^https?:/*(?=https?://)", "")
    relative = {"plain": F.concat(base, F.lit("/"), F.regexp_replace(u, r"^[./]+", "")), "strict": u}
    relative["dots"] = relative["repair"] = relative["plain"]
    out = F.when(u == "", F.lit("")).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(base, u))
    if variant == "dots":
        out = out.when(F.startswith(u, F.lit("../")), F.concat(base, F.lit("/"), F.regexp_replace(u, r"^(?:\.\./)+", "")))
    return out.when(F.startswith(u, F.lit("http")), u).otherwise(relative[variant])


def cdn_url(prefix: str, path: Column) -> Column:
    """P4c. Absolute as it is, else behind the prefix; empty stays empty."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).when(F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit(prefix), path))


LEAD = r"^(?:\[[^\]]*\]\s*)+"


def lead_tags(c: Column) -> Column:
    """P5. What stands in leading [..] groups, as an array."""
    return F.regexp_extract_all(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), LEAD, 0), F.lit(r"\[([^\]]+)\]"), F.lit(1))


def strip_lead_tags(c: Column) -> Column:
    """P5. The text behind leading [..] groups."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), LEAD, ""))


def clean_title(c: Column, drop_prefix: str = "", drop_suffix: str = "", cut_over: int = 60, untag_over: int = 30) -> Column:
    """P6. Without the site's prefix and suffix (patterns); the last part behind '|' or '-' goes only from a title
    longer than cut_over, one leading tag only from one longer than untag_over."""
    t = clean_text(c)
    for p in ([f"^(?:{drop_prefix})"] if drop_prefix else []) + ([f"(?:{drop_suffix})$"] if drop_suffix else []):
        t = F.trim(F.regexp_replace(t, p, ""))
    t = F.when(F.length(t) > cut_over, F.regexp_replace(t, r"\s*[|\-]\s*[^|\-]*$", "")).otherwise(t)
    return F.when(F.length(t) > untag_over, F.regexp_replace(t, r"^\[[^\]]*\]\s*", "")).otherwise(t)


def stable_id(site: Column, sid: Column) -> Column:
    """P7."""
    return F.concat_ws("-", site, sid)


def ordered_uniq(xs: Column) -> Column:
    """P8. Without empty items and data: URLs, first places kept."""
    return F.array_distinct(F.filter(xs, lambda x: (F.coalesce(x, F.lit("")) != "") & ~F.startswith(x, F.lit("data:"))))


def drop_boilerplate_images(xs: Column, pattern: str) -> Column:
    """P9. Without items whose lower-cased text matches the pattern."""
    return F.filter(xs, lambda x: ~F.lower(x).rlike(pattern))


def full_size_image(u: Column) -> Column:
    """P10. Thumbnail folder of an image URL replaced by that of the full size."""
    return F.regexp_replace(u, "/(small|tiny|medium)/", "/big/")


def own_images(xs: Column, sid: Column) -> Column:
    """P10b. Images whose path holds the item's id as a whole number; if there are none, those that hold it at all."""
    strict = F.filter(xs, lambda x: F.regexp_like(x, F.concat(F.lit("(?<![0-9])"), sid, F.lit("(?![0-9])"))))
    return F.when(F.size(strict) > 0, strict).otherwise(F.filter(xs, lambda x: F.contains(x, sid)))


def img_src(page: Column) -> Column:
    """P27. All image sources of an HTML fragment, in order, quoted or not, with character references decoded."""
    found = F.regexp_extract_all(page, F.lit(r"""(?is)<img\b[^>]*?\ssrc\s*=\s*("[^"]+"|'[^']+'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda x: unescape(F.regexp_replace(x, r"""^["']|["']$""", "")))


def price_policy(listed: Column, sale: Column, policy: str = "list_first", text: Column | None = None, ask: str = "call") -> Column:
    """P11. struct<price, list_price, sale_price, inquiry> from a list and a sale price (0 or null: none).

    list_first: price is the list price, else the sale price. equal_is_none: a list price equal to the sale price
    is none. inverted_is_none: so is one below it. phone_inquiry: no sale price where the text says to ask, and
    inquiry only without a list price. inquiry: price 0.
    """
    zero = F.lit(0).cast("bigint")
    listed, sale = F.coalesce(listed, zero).cast("bigint"), F.coalesce(sale, zero).cast("bigint")
    asks = F.lit(False)
    if policy == "equal_is_none":
        listed = F.when(listed == sale, zero).otherwise(listed)
    elif policy == "inverted_is_none":
        listed = F.when(listed < sale, zero).otherwise(listed)
    elif policy == "phone_inquiry":
        asks = F.contains(F.coalesce(text, F.lit("")), F.lit(ask))
        sale = F.when(asks, zero).otherwise(sale)
    price = F.coalesce(F.when(listed != 0, listed), sale)
    inquiry = (asks & (listed == 0)) | (price == 0) if policy == "phone_inquiry" else price == 0
    return F.struct(price.alias("price"), listed.alias("list_price"), sale.alias("sale_price"), inquiry.alias("inquiry"))


def last_nonzero(values: Column) -> Column:
    """P11c. The last assignment in a page that is not zero, else 0."""
    numbers = F.filter(F.transform(values, price_num), lambda x: x > 0)
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(0).cast("bigint"))


def minor_to_major(n: Column) -> Column:
    """P13. Cents to an amount with two decimals."""
    return F.round(n / 100, 2)


def join_categories(names: Column, n: int, default: str) -> Column:
    """P14. The first n names, joined; a default if there are none."""
    return F.coalesce(present(F.array_join(F.slice(names, 1, n), " / ")), F.lit(default))


def slugify(c: Column) -> Column:
    """P15. Lower-cased, other runs as '_', trimmed; empty gives 'etc'."""
    return F.coalesce(present(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))), F.lit("etc"))


def strip_first_word_in(c: Column, words: Sequence[str]) -> Column:
    """P16. Without a first word of the list; the text itself if nothing would be left."""
    short = F.trim(F.regexp_replace(c, r"(?i)^(?:" + "|".join(rf"\Q{w}\E" for w in words) + r")\s+", ""))
    return F.coalesce(present(short), c)


def strip_suffixes(c: Column, suffixes: Sequence[str]) -> Column:
    """P17. Each suffix in turn, where more than two characters stay; trimmed, the text itself if nothing would be left."""
    whole = c
    for x in suffixes:
        c = F.when(F.endswith(c, F.lit(x)) & (F.length(c) > len(x) + 2), F.substring(c, F.lit(1), F.length(c) - len(x))).otherwise(c)
    return F.coalesce(present(F.trim(c)), whole)


def nth_level(path: Column, i: int) -> Column:
    """P18. Level i (from 1) of a category path, else ''."""
    return F.coalesce(F.try_element_at(path, F.lit(i)), F.lit(""))


def path_after_brand(path: Column, names: Column, category: Column, default: str) -> Column:
    """P19. What follows the first level that is one of the brand's spellings (all, if none is), in any case; if
    that is empty the category, else the default."""
    flags = F.transform(path, lambda x: F.exists(names, lambda n: F.lower(n) == F.lower(x)))
    at = F.array_position(flags, F.lit(True)).cast("int")
    rest = F.slice(path, at + 1, F.size(path))
    rest = F.filter(rest, lambda x: x != "")
    return F.when(F.size(rest) > 0, rest).otherwise(F.array(F.coalesce(present(category), F.lit(default))))


def html_escape(c: Column) -> Column:
    """P20."""
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.coalesce(c, F.lit("")))


def format_price(price: Column, usd: Column | None = None, unit: str = " won", ask: str = "ask") -> Column:
    """P21. Local price, else the dollar price (where given), else the word for asking."""
    out = F.when(price > 0, F.concat(F.format_number(price, 0), F.lit(unit)))
    if usd is not None:
        out = out.when(usd > 0, F.concat(F.lit("$"), F.format_number(usd, 2)))
    return out.otherwise(F.lit(ask))


def product_url(site: str, slug: Column, pid: Column) -> Column:
    """P22."""
    return F.concat(F.lit(site + "/product/"), slug, F.lit("/"), pid, F.lit(".html"))


def structured_data(name: Column, brand: Column, category: Column, url: Column, images: Column, price: Column, currency: str = "KRW") -> Column:
    """P23. A product document as JSON: image only where there is one, offers only for a price over 0."""
    offers = F.when(price > 0, F.struct(F.lit("Offer").alias("@type"), F.lit(currency).alias("priceCurrency"), price.alias("price"), url.alias("url")))
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), name.alias("name"),
        F.struct(F.lit("Brand").alias("@type"), brand.alias("name")).alias("brand"), category.alias("category"), url.alias("url"),
        F.when(F.size(images) > 0, images).alias("image"), offers.alias("offers"),
    )
    return F.to_json(doc)


def meta_text(name: Column, brand: Column, path: Column, price_text: Column) -> Column:
    """P24. struct<title, description, keywords> of a product page."""
    return F.struct(
        F.format_string("%s - %s", name, brand).alias("title"), F.format_string("%s %s | %s | %s", brand, name, F.array_join(path, " > "), price_text).alias("description"),
        F.array_join(F.array_distinct(F.concat(F.array(name, brand), path)), ", ").alias("keywords"),
    )


def hero_image(images: Column) -> Column:
    """P25. struct<main, thumb>: the main images, else the thumbnail alone; the thumbnail, else the first main image."""
    main, thumb = F.coalesce(images["main"], F.array().cast("array<string>")), F.coalesce(images["thumb"], F.lit(""))
    shown = F.when(F.size(main) > 0, main).when(thumb != "", F.array(thumb)).otherwise(F.array().cast("array<string>"))
    return F.struct(shown.alias("main"), F.coalesce(present(thumb), F.try_element_at(main, F.lit(1)), F.lit("")).alias("thumb"))


def rekey_url(u: Column, old: Column, new: Column) -> Column:
    """P26. The brand's segment of a media URL changed."""
    return F.replace(u, F.concat(F.lit("/"), old, F.lit("/")), F.concat(F.lit("/"), new, F.lit("/")))
