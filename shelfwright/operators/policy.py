"""Which sources may show a brand's products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_junk(path: Column, category: Column, name: Column, words: tuple[str, ...], name_pattern: str) -> Column:
    """F1. A word of the list in the joined path and category, or the pattern in the name in any case."""
    joined = F.concat_ws(" ", F.array_join(F.coalesce(path, F.array().cast("array<string>")), " "), F.coalesce(category, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(joined, F.lit(w)) for w in words], F.lit(False)) | F.coalesce(name, F.lit("")).rlike("(?i)" + name_pattern)


def source_index(products: DataFrame, key: str = "slug", source: str = "source") -> DataFrame:
    """A1. (key, sources) from all records, junk included."""
    return products.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def allowed(junk: Column, key: Column, source: Column, sources: Column, tier1: list[str], demoted: str, pinned: dict[str, str]) -> Column:
    """F2. Junk goes; a pinned brand keeps its one source; a real brand (no leading underscore) with a first-tier source keeps those; the demoted
    source stays only where it is the only one; all else stays. The order matters."""
    sources = F.coalesce(sources, F.array().cast("array<string>"))
    out = F.when(junk, F.lit(False))
    for k, v in pinned.items():
        out = out.when(key == k, source == v)
    first = F.array(*[F.lit(t) for t in tier1])
    out = out.when(~F.startswith(key, F.lit("_")) & F.arrays_overlap(sources, first), source.isin(*tier1))
    out = out.when(source == demoted, F.size(F.array_except(sources, F.array(F.lit(demoted)))) == 0)
    return F.coalesce(out.otherwise(F.lit(True)), F.lit(False))


def with_policy(products: DataFrame, tier1: list[str], demoted: str, pinned: dict[str, str], key: str = "slug", source: str = "source", junk: Column | None = None) -> DataFrame:
    """J1 and F2. The products that the policy allows. The index is one narrow aggregate of (key, source)."""
    index = source_index(products, key, source)
    joined = products.join(index, key, "left")
    return joined.where(allowed(F.lit(False) if junk is None else junk, F.col(key), F.col(source), F.col("sources"), tier1, demoted, pinned)).drop("sources")


def block_urls(xs: Column, blocked: Column) -> Column:
    """F5. Without the blocked URLs, order and repeats kept."""
    return F.filter(xs, lambda x: ~F.array_contains(blocked, x))


def block_url_rows(images: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """F5 for a blocklist of any size: image rows without those whose URL is listed."""
    return images.join(blocklist.select(F.col(blocklist.columns[0]).alias(url)).distinct(), url, "left_anti")
