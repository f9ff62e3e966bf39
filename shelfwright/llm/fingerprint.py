"""Document fingerprints by consistent weighted sampling (operator 8), in DataFrame operations only.

For each of SAMPLES draws, every weighted term (a word and its count S) has r and c from Gamma(2, 1) and b from
[0, 1). With t = floor(ln S / r + b) and a = c / exp(r (t - b + 1)), the term with the smallest a is drawn, together
with t. Two texts draw the same (term, t) with the probability of their generalised Jaccard similarity (sum of smaller
weights over sum of larger weights).

The variates come from hashes of term and draw, in a form that leaves little to compute. The sum of two exponential
variates is a Gamma(2, 1) one, and its first part's share is uniform and independent of it. So c = e1 + e2 with uniform
u1 = e1 / c; and with another uniform u2, r = -ln(u1 u2) and b = ln u2 / ln(u1 u2). Then a = e1 (u1 u2)^t, and t is the
whole part of (ln S - ln u2) / r. A term that stands once has t = 0 and a = e1, whatever the other variates are;
1 - exp(-a) is then the uniform number that e1 is made of, so its hash itself is what is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

SAMPLES = 64
#: Documents in one block of neighbours; blocks at most (the driver gets a row for each); quantiles of doc_id in the plan at most.
BLOCK_DOCS, BLOCKS_MOST, CUTS_MOST = 500, 1 << 20, 1024
SPACE, WORDS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def draws(term: str, weight: str, first: str, k: int) -> Column:
    """A term's draw k as a long: in its upper bits what is compared, 1 - exp(-a); the lower ones tell (term, t). `first` is the column
    of the draw's first hash."""
    part = lambda h: (F.shiftrightunsigned(h, 12) + 0.5) / float(1 << 52)
    once = F.shiftrightunsigned(first, 1)
    e1, e2 = -F.log1p(-part(F.col(first))), -F.ln(part(F.xxhash64(term, F.lit(-1 - 2 * k))))
    u1, u2 = e1 / (e1 + e2), part(F.xxhash64(term, F.lit(-2 - 2 * k)))
    t = F.floor((F.ln(weight) - F.ln(u2)) / -F.ln(u1 * u2))
    a = e1 * F.pow(u1 * u2, t)
    more = F.shiftleft((-F.expm1(-a) * float(1 << 39)).cast("long"), 24).bitwiseOR(F.xxhash64(term, t, F.lit(k)).bitwiseAND(F.lit(0xFFFFFF)))
    return F.when(F.col(weight) == 1, once).when(t == 0, once).otherwise(more)


def sketches(rows: DataFrame, keys: list[str], first: str, second: str, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of two text columns: keys, fp and efp, arrays of draws (null for a text without words).

    Rows must be dealt out by a subset of the keys, which tell every row; then nothing is shuffled here. A term of equal weight
    in both texts is drawn for once.
    """
    words = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate((first, second))])).alias("x"))
    words = words.select(*keys, F.col("x.i").alias("i"), F.explode(F.split("x.t", SPACE)).alias("word")).where("word <> ''")
    weights = words.select(*keys, "i", F.xxhash64("word").alias("term")).groupBy(*keys, "term")
    weights = weights.agg(*[F.count(F.when(F.col("i") == i, 1)).alias(f"s{i}") for i in range(2)])
    own, edited = (F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("w")) for i in range(2))
    both = F.struct(F.lit(2).alias("i"), F.col("s0").alias("w"))
    held = F.when(F.col("s0") == F.col("s1"), F.array(both)).when(F.col("s1") == 0, F.array(own)).when(F.col("s0") == 0, F.array(edited)).otherwise(F.array(own, edited))
    weights = weights.select(*keys, "term", F.explode(held).alias("x")).select(*keys, "term", "x.i", "x.w", *[F.xxhash64("term", F.lit(k)).alias(f"h{k}") for k in range(samples)])
    found = weights.groupBy(*keys, "i").agg(*[F.min(draws("term", "w", f"h{k}", k)).alias(f"m{k}") for k in range(samples)])
    found = found.select(*keys, "i", F.array(*[f"m{k}" for k in range(samples)]).alias("m"))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(3)])
    least = lambda a: F.when(F.col(a).isNull(), F.col("m2")).when(F.col("m2").isNull(), F.col(a)).otherwise(F.zip_with(a, "m2", lambda x, y: F.least(x, y)))
    return found.select(*keys, least("m0").alias("fp"), least("m1").alias("efp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws; null where one has none."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.when(a.isNotNull() & b.isNotNull(), F.size(a))


def as_text(a: str) -> Column:
    """Six hex digits for each draw; empty for a text without words."""
    digits = F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def block_of(docs: DataFrame, blocks: int) -> Column:
    """The number of a row's block: blocks follow the order of (doc_id, tk). Quantiles of doc_id cut the rows; where more blocks are
    asked for, the range between two is cut evenly. Rows of a doc_id that holds several quantiles are dealt out by tk."""
    cuts = min(CUTS_MOST, blocks)
    if cuts < 2:
        return F.lit(0)
    at = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("q"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if at["q"] is None:
        return F.lit(0)
    bounds = F.array(*[F.lit(int(c)) for c in at["q"]])
    before, upto = F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    number = (before + F.floor((F.col("tk") / float(1 << 64) + 0.5) * (upto - before))).cast("int")
    each = -(-blocks // cuts)
    if each > 1:
        ends = [int(at["low"]) - 1, *map(int, at["q"]), int(at["high"])]
        low, width = F.array(*[F.lit(x) for x in ends[:-1]]), F.array(*[F.lit(max(1, b - a)) for a, b in zip(ends, ends[1:])])
        place = F.floor(each * ((F.col("doc_id") - F.get(low, before) - 1) / F.get(width, before)))
        number = number * each + F.when(upto > before, F.lit(each - 1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(each - 1), place))).cast("int")
    return F.coalesce(number, F.lit(0))


def in_blocks(docs: DataFrame) -> DataFrame:
    """Rows dealt into blocks of neighbouring doc_id: (block, ghost, doc_id, tk, text). Each block also gets, as a ghost, the
    row that stands before its first, or the last of all."""
    n = docs.count()
    rows = docs.withColumn("block", block_of(docs, int(min(BLOCKS_MOST, max(1, n // BLOCK_DOCS)))))
    ends = {r["block"]: (r["m"]["doc_id"], r["m"]["tk"]) for r in rows.groupBy("block").agg(F.max(F.struct("doc_id", "tk")).alias("m")).collect()}  # a row for each block
    order = sorted(ends)
    spare = [(*ends[before], b) for before, b in zip([*order[-1:], *order], order)]
    # nothing null here, so that no filter tells two uses of the rows apart and their texts are shuffled once for both
    spare = docs.sparkSession.createDataFrame(spare, f"g {docs.schema['doc_id'].dataType.simpleString()}, gk long not null, ghost_block int not null")
    ghosts = docs.join(F.broadcast(spare), F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("tk") == F.col("gk")))
    columns = ("doc_id", "tk", "text")
    return rows.select("block", F.lit(0).alias("ghost"), *columns).unionByName(ghosts.select(F.col("ghost_block").alias("block"), F.lit(1).alias("ghost"), *columns))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The edited text is the text with its last floor(n/2) code points replaced by the first ones of the next
    document, by descending doc_id (after the last comes the first). Returns (doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next). A null text is empty; texts without words have the
    empty fingerprint. Repeated rows of one doc_id follow each other, ordered by a hash of the text; rows without doc_id come
    last. No rows give no rows; other columns are not read. doc_id must be an integer. The texts are shuffled once.
    """
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tk", F.xxhash64("text"))
    order = Window.partitionBy("block").orderBy(F.desc("ghost"), F.asc_nulls_first("doc_id"), "tk")
    rows = in_blocks(docs).withColumn("rn", F.row_number().over(order)).withColumn("next", F.coalesce(F.lag("text").over(order), F.lit("")))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next, cast(floor(length(text) / 2) as int))")))
    found = sketches(rows, ["block", "rn"], "text", "edited", samples)
    before = Window.partitionBy("block").orderBy("rn")
    after = F.when(F.lag("rn").over(before) == F.col("rn") - 1, F.lag("fp").over(before))
    found = found.withColumn("nfp", after).select(
        "block", "rn", as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
    # two texts without words are alike, one is unlike any other text
    none = lambda c: ~F.col(c).rlike(WORDS)
    plain = lambda a, b: F.when(none(a) & none(b), F.lit(1.0)).otherwise(F.lit(0.0))
    facts = rows.where("ghost = 0").select(
        "block", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), plain("text", "edited").alias("plain_edited"), plain("text", "next").alias("plain_next")
    )
    return facts.join(found, ["block", "rn"], "left").select(
        "doc_id", "n_chars", "edited_sha256", *[F.coalesce(c, F.lit("")).alias(c) for c in ("fingerprint", "edited_fingerprint")],
        F.coalesce("near_edited", "plain_edited").alias("near_edited"), F.coalesce("near_next", "plain_next").alias("near_next"),
    )
