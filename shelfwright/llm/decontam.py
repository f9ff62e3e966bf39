"""Benchmark decontamination by spaced seeds (operator 10), in DataFrame operations only.

A mask keeps some word positions of a short stretch and ignores the others, so a stretch with substituted
words at ignored positions still has the same hash. Hashes of the benchmark's stretches are joined with those
of all documents; around each hit the aligned words are counted.

The masks find every passage that the threshold admits: whatever fifth of the words is substituted, in one place one mask sees
none of them. Items of fewer words than that holds for have a shorter mask too, and very short items must stand as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pick, save

#: Kept positions of each mask.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 4, 7, 8), (0, 1, 2, 5, 7, 9), (0, 1, 4, 6, 9, 10))
SPAN = 8
#: A mask for items of SPAN to LONG - 1 words, and its span. With it all passages of up to a fifth substituted words are found.
SHORT_MASK, SHORT_SPAN, LONG = (0, 1, 3), 4, 18
#: Items of fewer words than SPAN must stand word for word; those of fewer than SHORTEST match nothing.
SHORTEST = 3
#: Words compared around a hit, and the percentage of them that must be equal.
WINDOW, PERCENT = 20, 80
#: Benchmark stretches in one broadcast; more are joined in blocks.
BLOCK_ROWS = 1_000_000
NON_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hash of each lower-cased run of letters and digits; null gives none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, " ")), " ")
    return F.when(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NON_WORD, "")) > 0, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def seeds(words: str, pos: str, masks: dict[int, tuple[int, ...]], room: dict[int, Column]) -> Column:
    """The hash of each mask laid at a position, as an array; null where room[mask] is not true."""
    return F.array(*[F.when(room[i], F.xxhash64(F.lit(i), *[F.get(words, F.col(pos) + o) for o in mask])) for i, mask in masks.items()])


def laid(df: DataFrame, words: str, masks: dict[int, tuple[int, ...]], room: dict[int, Column], least: int, *keep: str) -> DataFrame:
    """A narrow row for each mask at each position: (keep..., pos, seed); `least` words must be left. The words don't go along."""
    rows = df.where(F.size(words) >= least).select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - least)).alias("pos"))
    return rows.select(*keep, "pos", F.explode(seeds(words, "pos", masks, room)).alias("seed")).where("seed is not null")


def best_window(doc: Column, item: Column, shift: Column) -> Column:
    """Most equal words in any WINDOW aligned words (of the item, if it is shorter); doc position = item position + shift."""
    equal = lambda k: (F.get(doc, k + shift) == F.get(item, k)).cast("int")
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(doc) - shift) - 1

    def step(acc: Column, k: Column) -> Column:
        now = acc["now"] + equal(k) - F.when(k - WINDOW >= low, equal(k - WINDOW)).otherwise(F.lit(0))
        more = now > acc["best"]
        return F.struct(now.alias("now"), F.when(more, now).otherwise(acc["best"]).alias("best"), F.when(more, k).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.sequence(low, high), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(-1).alias("end")), step)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of a text and an item's text that match, once for each alignment: (doc_id, tk, item_id, n_equal, n_window, item_start, shift)."""
    items = pick(benchmark, "item_id", "text").select("item_id", word_hashes(F.col("text")).alias("item")).where(F.size("item") >= SHORTEST)
    items = save(items.withColumn("ik", F.xxhash64("item")))
    bodies, names = items.select("ik", "item").dropDuplicates(["ik"]), items.select("ik", "item_id").distinct()
    n = F.size("item")
    exact = sorted(r["n"] for r in bodies.where(n < SPAN).select(n.alias("n")).distinct().collect())  # SPAN - SHORTEST rows at most
    short = bodies.where((n >= SPAN) & (n < LONG)).limit(1).count() > 0
    masks = dict(enumerate(MASKS)) | ({len(MASKS): SHORT_MASK} if short else {}) | {len(MASKS) + k: tuple(range(k)) for k in exact}
    spans = {i: SPAN for i in range(len(MASKS))} | {len(MASKS): SHORT_SPAN} | {len(MASKS) + k: k for k in exact}
    least = min(spans[i] for i in masks)
    fits = {i: F.col("pos") <= F.size("words") - spans[i] for i in masks}
    size = F.size("words")
    own = {i: fits[i] & (size >= SPAN if i < len(MASKS) else size.between(SPAN, LONG - 1) if i == len(MASKS) else size == spans[i]) for i in masks}
    found = laid(bodies.withColumnRenamed("item", "words").withColumn("n_item", size), "words", masks, own, least, "ik", "n_item")
    found = save(found.select("seed", "ik", "n_item", F.col("pos").alias("item_pos")).distinct())
    blocks = max(1, -(-found.count() // BLOCK_ROWS))
    words = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("tk"), word_hashes(F.col("text")).alias("words"))
    rows = laid(words, "words", masks, fits, least, "doc_id", "tk")
    hits = None
    for b in range(blocks):
        block = found if blocks == 1 else found.where(F.pmod(F.xxhash64("ik"), F.lit(blocks)) == b)
        part = rows.join(F.broadcast(block), "seed").select("doc_id", "tk", "ik", "n_item", (F.col("pos") - F.col("item_pos")).alias("shift"))
        hits = part if hits is None else hits.unionByName(part)
    hits = save(hits.distinct()).withColumnRenamed("doc_id", "hit_id").withColumnRenamed("tk", "hit_tk")
    # only the stretch of the document that lies beside the item goes on
    near = words.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("tk").eqNullSafe(F.col("hit_tk")))
    near = near.select("doc_id", "tk", "ik", "shift", F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n_item") + F.least(F.col("shift"), F.lit(0))).alias("part")).distinct()
    checked = near.join(F.broadcast(bodies) if blocks == 1 else bodies, "ik")
    checked = checked.withColumn("w", best_window(F.col("part"), F.col("item"), F.least(F.col("shift"), F.lit(0)))).withColumn("n_window", F.least(F.lit(WINDOW), n))
    whole = checked.where(100 * F.col("w.best") >= F.when(n < SPAN, 100).otherwise(percent) * F.col("n_window"))
    whole = whole.select("doc_id", "tk", "ik", F.col("w.best").alias("n_equal"), "n_window", F.greatest(F.lit(0), F.col("w.end") - F.col("n_window") + 1).alias("item_start"), "shift")
    return whole.join(F.broadcast(names) if blocks == 1 else names, "ik").drop("ik")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents that hold a benchmark passage, word substitutions allowed.

    A document and an item match when some WINDOW aligned words of them (or all of the item's, if fewer) are
    equal at `percent` of the places or more, found by a seed hit on the same alignment. Items of fewer than SPAN words
    match where all their words stand in a row, those of fewer than SHORTEST nowhere. Returns one row for each
    such pair: (doc_id, item_id, doc_start, item_start, n_window, n_equal, similarity) of its best window.
    Texts that are null or without words match nothing. Repeated rows give the same pair once; all texts of a repeated doc_id or item_id
    count; a null doc_id or item_id is a key like any other. Empty tables give no rows; other columns are not read.
    """
    best = matches(docs, benchmark, percent).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", -F.col("item_start"), -F.col("shift"), "n_window")).alias("m"))
    start = -F.col("m.col2")
    return best.select(
        "doc_id", "item_id", (start - F.col("m.col3")).cast("long").alias("doc_start"), start.cast("long").alias("item_start"),
        F.col("m.n_window").cast("long").alias("n_window"), F.col("m.n_equal").cast("long").alias("n_equal"), (F.col("m.n_equal") / F.col("m.n_window")).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns, whatever their names. Rows without doc_id are judged by their
    text; repeated rows go or stay together."""
    bad_id, bad_tk, tk = (fresh(docs, x) for x in ("bad_id", "bad_tk", "tk"))
    found = matches(docs, benchmark).select(F.col("doc_id").alias(bad_id), F.col("tk").alias(bad_tk)).distinct()
    rows = docs.withColumn(tk, F.xxhash64("text"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col(bad_id)) & F.col(tk).eqNullSafe(F.col(bad_tk)), "left_anti").drop(tk)
