"""Personal data and the terms that give it away (operator 2), in DataFrame operations only.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value is a protected
entity. The corpus then tells which words of the texts that hold an entity disclose it: a word t discloses entity v
if knowing t removes most of v's information, PMI(v, t) / IC(v) = 1 + log p(v | t) / IC(v) at or over a threshold,
counted over whole distinct texts. Such words are marked wherever they stand. When texts are cleaned they are generalised to
[TERM]; those that give an entity away in full (REMOVAL) are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pick, save

#: Kinds in their order, patterns (possessive: nothing after a repeat could make it give back), and a cheap test for a text. A run is
#: tried from its start only (or from the end of the match before): from inside, the same would follow. So time is in proportion to length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
#: Distinct texts in which a word must stand with an entity, and the share of the entity's information it must give.
MIN_TEXTS, DISCLOSURE = 3, 0.85
#: From this share on a term is removed, not generalised.
REMOVAL = 0.999
#: Disclosing terms that are broadcast, at most; more are joined by shuffling the words.
BROADCAST_TERMS = 400_000
#: Stands for a base span while words are read: a code point that is no character.
GAP = "\ufdd0"
WORD = r"[\p{L}]{3,}"
FREE_WORD = rf"(?<![\p{{L}}{GAP}])\p{{L}}{{3,}}+(?!{GAP})"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
MATCH = "struct<start:int,end:int,value:string>"
#: Elements that scanned works off at a time.
BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: an expression that a lambda holds is worked out anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(xs: Column, zero: Column, step, kind: str) -> Column:
    """Arrays that step(state, x) -> (state, array of `kind`) gives for each x in turn, in one. An array that grows is copied at each step, so
    BLOCK elements at a time are worked off: a thousand times as many take little more than a thousand times as long."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def add(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda c: F.slice(v, c * BLOCK + 1, BLOCK))
    return F.aggregate(let(xs, parts), F.struct(zero.alias("state"), nothing.alias("out")), block, lambda acc: F.flatten(acc["out"]))


def matches(text: str, pattern: str, keep: str | None = None) -> Column:
    """Leftmost non-overlapping matches in a text column, as array<struct<start, end, value>>, in code points. keep: SQL that says of a match (x.m) whether
    it counts; others are stepped over, which is cheaper than to leave them out afterwards.

    The pieces between the matches give their places. This is `scanned` said in SQL, since it stands in a plan several times.
    """
    pieces = f"zip_with(regexp_extract_all({text}, r'{pattern}', 0), split({text}, r'{pattern}', -1), (m, g) -> if(m IS NULL, NULL, named_struct('m', m, 'g', length(g))))"
    blocks = f"transform(sequence(0, cast(floor(greatest(size(v) - 1, 0) / {BLOCK}) AS int)), b -> slice(v, b * {BLOCK} + 1, {BLOCK}))"
    found = "concat(a.out, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + length(x.m), 'value', x.m)))"
    found = f"if({keep}, {found}, a.out)" if keep else found
    # no match follows the last piece
    one = f"if(x IS NULL, a, named_struct('at', a.at + x.g + length(x.m), 'out', {found}))"
    block = f"aggregate(part, named_struct('at', acc.at, 'out', cast(array() AS array<{MATCH}>)), (a, x) -> {one})"
    step = f"transform(array({block}), i -> named_struct('at', i.at, 'out', concat(acc.out, array(i.out))))[0]"
    whole = f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() AS array<array<{MATCH}>>)), (acc, part) -> {step}, acc -> flatten(acc.out))"
    return F.expr(f"transform(array({pieces}), v -> {whole})[0]")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    signs = F.reverse(F.split(number, ""))

    def add(total: Column, i: Column) -> Column:
        d = F.get(signs, i).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def octets_fit(value: Column) -> Column:
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.try_to_number(F.lpad(p, 3, "0"), F.lit("999")) <= 255))


def base_spans(name: str) -> Column:
    """All base spans of a text column: array<struct<kind, start, end, value>>, by kind and start; kind is its place in KINDS."""
    text = F.col(name)
    none = F.array().cast(SPAN)

    def kind(number: int, pattern: str, maybe: Column, good) -> Column:
        kept = F.filter(matches(name, pattern), lambda m: good(m["value"]))
        return F.when(maybe, F.transform(kept, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))).otherwise(none)

    size = lambda v: F.length(digits(v))
    return F.concat(
        kind(0, EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        kind(1, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), octets_fit),
        kind(2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda v: size(v).between(16, 19) & luhn(digits(v))),
        kind(3, PHONE, F.contains(text, F.lit("+")), lambda v: size(v).between(8, 15)),
    )


def entity(kind: Column, value: Column) -> Column:
    """The protected entity of a value: case and signs in numbers don't matter."""
    return F.xxhash64(kind, F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(digits(value)))


def word_hashes(text: Column) -> Column:
    """The distinct words of a text, hashed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def replaced(text: Column, spans: Column, name) -> Column:
    """The text with name(span) for each span; overlapping spans are replaced as one, by the earliest (then longest).

    A part of a text is found by counting from its beginning, so the text is first cut into pieces of about sqrt(n) of its n spans: the time is
    text length times sqrt(n).
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"), s["value"].alias("value"))))
    one = "struct<start:int,last:int,kind:int,value:string>"
    mark = lambda start, last, kind: F.struct(F.lit(start).alias("start"), F.lit(last).alias("last"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"))

    def join(held: Column, s: Column) -> tuple[Column, Column]:
        """A span that begins behind the one held ends it; any other makes it longer, if it ends later."""
        begins = s["start"] >= -held["last"]
        longer = F.struct(held["start"].alias("start"), F.least(held["last"], s["last"]).alias("last"), held["kind"].alias("kind"), held["value"].alias("value"))
        return F.when(begins, s).otherwise(longer), F.when(begins & (held["kind"] >= 0), F.array(held)).otherwise(F.array().cast(f"array<{one}>"))

    order = F.concat(order, F.array(mark(2**31 - 1, 1 - 2**31, 0)))  # ends the last

    def whole(held: Column) -> Column:
        size = F.size(held)
        root = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
        end = lambda i: F.when(i < 0, F.lit(0)).otherwise(-F.get(held, i)["last"])  # noqa: E731  of span i; the text's beginning for -1

        def piece(c: Column) -> Column:
            low, high = end(c * root - 1), end(F.least((c + 1) * root, size) - 1)
            inside = lambda big: F.array_join(F.transform(F.slice(held, c * root + 1, root), lambda s, i: F.concat(F.substring(big, end(c * root + i - 1) - low + 1, s["start"] - end(c * root + i - 1)), name(s))), "")
            return let(F.substring(text, low + 1, high - low), inside)

        pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / root).cast("int")), piece)
        return F.when(size == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, end(size - 1) + 1, F.length(text))))

    return let(scanned(order, mark(0, 0, -1), join, one), whole)


def together(base: DataFrame, min_texts: int) -> tuple[DataFrame, DataFrame]:
    """(entity, term, both) over the distinct words of each whole text that holds the entity, words that touch a base span left out, and
    (entity, with_entity). Only entities that stand in min_texts texts can have such terms."""
    some = base.where(F.size("spans") > 0)
    held = save(some.select("tk", F.explode(F.array_distinct(F.transform("spans", lambda s: entity(s["kind"], s["value"])))).alias("entity")).distinct())
    alone = save(held.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= min_texts))
    asked = held.join(alone, "entity", "left_semi").groupBy("tk").agg(F.collect_list("entity").alias("entities"))
    texts = some.groupBy("tk").agg(F.first(F.struct("text", "spans")).alias("x")).join(asked, "tk")
    rest = F.regexp_replace(replaced(F.col("x.text"), F.col("x.spans"), lambda s: F.lit(GAP)), rf"\p{{L}}*+{GAP}(?:\p{{L}}|{GAP})*+", " ")
    pairs = texts.select("entities", F.explode(word_hashes(rest)).alias("term")).select(F.explode("entities").alias("entity"), "term")
    return pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= min_texts), alone


def disclosing(base: DataFrame, words: DataFrame, min_texts: int, disclosure: float) -> DataFrame:
    """(term, whole): the terms that give away an entity, by counts over distinct texts of the whole corpus; whole: one of them in full. words:
    (tk, hashes) of each distinct text."""
    both, alone = together(base, min_texts)
    both = save(both)
    total = words.count()
    frequency = words.select(F.explode("hashes").alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    pairs = both.join(frequency, "term").join(alone, "entity")  # the words are counted first, whatever terms are asked for
    share = F.least(F.lit(1.0), F.col("both") / F.col("with_term"))
    information = F.ln(F.lit(float(max(total, 2))) / F.col("with_entity"))
    told = (1 + F.ln(share) / F.greatest(information, F.lit(1e-9))).alias("told")
    return pairs.select("term", told).where(F.col("told") >= disclosure).groupBy("term").agg((F.max("told") >= REMOVAL).alias("whole"))


def occurrences(docs: DataFrame, words: DataFrame, terms: DataFrame) -> DataFrame:
    """All places of the terms in all texts, those that touch a base span left out: (doc_id, tk, terms), array<struct<start, end, whole>>."""
    terms = save(terms)
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    asked = words.select("tk", F.explode("hashes").alias("term")).join(terms, "term").groupBy("tk").agg(F.collect_set("term").alias("asked"), F.collect_set(F.when(F.col("whole"), F.col("term"))).alias("wholes"))
    rows = docs.join(save(asked), "tk").dropDuplicates(["doc_id", "tk"])
    # letters of base spans become signs that are no letters, and words next to such signs are none
    free = replaced(F.col("text"), base_spans("text"), lambda s: F.regexp_replace(s["value"], r"\p{L}", GAP))
    rows = rows.select("doc_id", "tk", "asked", "wholes", free.alias("free"))

    found = matches("free", FREE_WORD, "array_contains(asked, xxhash64(lower(x.m)))")
    whole = lambda m: F.array_contains("wholes", F.xxhash64(F.lower(m["value"])))
    return rows.select("doc_id", "tk", F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), whole(m).alias("whole"))).alias("terms"))


def find_spans(docs: DataFrame, min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """All spans of every whole text: (doc_id, tk, spans, base), arrays of (kind, start, end, value) by kind and start.

    `tk` is a hash of the text. base holds only the pattern matches; spans holds every place of a disclosing term too
    (value 'whole' if it gives an entity away in full, else null), in texts with and without the entity. Terms are counted over distinct texts, so
    copies change nothing. A null text is empty; repeated rows keep their own spans; no rows give no rows; other columns are not read.
    """
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tk", F.xxhash64("text"))
    base = docs.select("doc_id", "tk", "text", base_spans("text").alias("spans"))
    base = save(base.select("doc_id", "tk", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))
    words = save(docs.select("tk", word_hashes(F.col("text")).alias("hashes")).groupBy("tk").agg(F.first("hashes").alias("hashes")))
    terms = occurrences(docs, words, disclosing(base, words, min_texts, disclosure)).select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "terms")
    marked = base.join(terms, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")
    more = F.transform("terms", lambda t: F.struct(F.lit(4).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.when(t["whole"], F.lit("whole")).alias("value")))
    return marked.select("doc_id", "tk", F.concat("spans", F.coalesce(more, F.array().cast(SPAN))).alias("spans"), F.col("spans").alias("base"))


def span_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_spans: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term)."""
    count = lambda i, c="base": F.size(F.filter(c, lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"), count(4, "spans").alias("n_term"))


def sanitise(docs: DataFrame, min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """The documents with their personal data generalised to [EMAIL], [IP], [CARD], [PHONE], and disclosing terms to [TERM]; terms that
    give an entity away in full are removed.

    All columns stay, whatever their names; n_chars, where there is one, follows the text. Overlapping spans are replaced as one, by the
    earliest (then longest). A null text stays null, an empty one empty; repeated rows are all cleaned; rows without doc_id too.
    """
    other_id, other_tk, key, spans = (fresh(docs, x) for x in ("other_id", "other_tk", "key", "spans"))
    found = find_spans(docs, min_texts, disclosure).where(F.size("spans") > 0).dropDuplicates(["doc_id", "tk"])
    found = found.select(F.col("doc_id").alias(other_id), F.col("tk").alias(other_tk), F.col("spans").alias(spans))
    joined = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(found, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_tk)), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = replaced(F.col("text"), F.col(spans), lambda s: F.when((s["kind"] == 4) & s["value"].isNotNull(), F.lit("")).otherwise(F.get(names, s["kind"])))
    new = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
