"""License scans as an exact set-similarity join (operator 6), in DataFrame operations only.

Blocks are lines of any length, and runs of words across line ends, where a notice may be wrapped: twice as many
words as the template has. Runs are read only in texts that hold enough of a template's tokens at all. Each template's tokens are put in one global order, rarest in the corpus first. A block that
holds the threshold share of a template's tokens must hold one of its first few (prefix filter), have enough
tokens itself (length filter), and, by the place of the first common token, still have enough of the
template's tokens left (positional filter). Only such pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, save

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates, label and text. Usual notices of well-known licenses, and sentences of their bodies.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the Apache License Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("reserved", "All rights reserved"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    ("apache-2.0", "you may not use this file except in compliance with the License You may obtain a copy of the License at"),
    ("apache-2.0", "software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied"),
    ("bsd", "Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
)
PERCENT = 80
#: Words of a run across line ends, for each word of the template.
RUN = 2
#: What stands between words: everything in ASCII but letters and digits.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased; null gives ''. Other letters may change case too, which no result shows: the one letter that would turn
    into an ASCII one (the Kelvin sign) is put aside first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0101")))


def template_tokens(text: str) -> list[str]:
    out: list[str] = []
    for part in "".join(c if c.isalnum() else " " for c in text).lower().split():
        if part not in out:
            out.append(part)
    return out


def wanted_tokens(templates, percent: int) -> Column:
    """The templates as array<struct<label, wanted, need, words>>: their tokens, how many must be common, and the words of a run."""
    rows = [(label, template_tokens(text), len(text.split())) for label, text in templates]
    return F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("wanted"), F.lit(-(-percent * len(tokens) // 100)).alias("need"), F.lit(RUN * n).alias("words")) for label, tokens, n in rows])


def read_words(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Each text read once: (doc_id, row, n_words, base, blocks, near, spread). blocks has the lines with two words of the templates
    or more: their number and these words, each once; base the places of the phrases; near the templates of which the whole text has
    enough tokens, and spread, where there is one, the places of their words."""
    vocabulary = sorted({t for _, text in templates for t in template_tokens(text)})
    lines = docs.select("doc_id", "row", lowered(F.col("text")).alias("low"))
    lines = lines.select("doc_id", "row", "low", F.transform(F.split("low", "\n"), lambda line: F.split(line, NON_WORD)).alias("lines"))
    # only the first and the last piece of a line can be empty
    count = lambda w: F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, w: acc + count(w))
    maybe = F.lit(False)
    for phrase, _ in PHRASES:
        maybe = maybe | F.contains("low", F.lit(max(phrase.split(), key=len)))
    words = F.when(maybe, F.filter(F.flatten("lines"), lambda w: w != ""))
    held = F.transform("lines", lambda w, i: F.struct(i.alias("block"), F.array_distinct(F.filter(w, lambda t: t.isin(vocabulary))).alias("tokens")))
    out = lines.select("doc_id", "row", total.alias("n_words"), words.alias("words"), F.filter(held, lambda b: F.size(b["tokens"]) > 1).alias("blocks"), "lines", F.array_distinct(F.filter(F.flatten("lines"), lambda t: t.isin(vocabulary))).alias("tokens"))
    out = out.withColumn("near", F.filter(wanted_tokens(templates, percent), lambda t: F.size(F.array_intersect(t["wanted"], F.col("tokens"))) >= t["need"]))
    places = F.filter(F.transform(F.filter(F.flatten("lines"), lambda w: w != ""), lambda t, i: F.struct(i.alias("at"), t.alias("token"))), lambda x: F.exists("near", lambda t: F.array_contains(t["wanted"], x["token"])))
    out = out.withColumn("spread", F.when(F.size("near") > 0, places))
    base = F.concat(*[phrase_places(phrase.split(), label) for phrase, label in PHRASES])
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return out.select("doc_id", "row", "n_words", F.when(F.col("words").isNotNull(), base).otherwise(none).alias("base"), "blocks", "near", "spread")


def ordered_templates(blocks: DataFrame, templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(number, label, tokens rarest first): the order is by the tokens' counts in all blocks, then by the token."""
    seen = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}  # a row for each word of the templates at most
    return [(i, label, sorted(template_tokens(text), key=lambda t: (counts.get(t, 0), t))) for i, (label, text) in enumerate(templates)]


def template_blocks(blocks: DataFrame, templates: list[tuple[int, str, list[str]]], percent: int = PERCENT) -> DataFrame:
    """All (block, template) pairs with 100 * |common tokens| >= percent * |template tokens|: (doc_id, row, block, label, containment)."""
    spark: SparkSession = blocks.sparkSession
    prefix = []
    for number, label, tokens in templates:
        need = -(-percent * len(tokens) // 100)
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            prefix.append((token, number, label, tokens, place, need))
    index = F.broadcast(spark.createDataFrame(prefix, "token string, template int, label string, wanted array<string>, place int, need int"))
    rows = blocks.select("doc_id", "row", "block", "tokens", F.explode("tokens").alias("token"))
    pairs = rows.join(index, "token").where(F.size("tokens") >= F.col("need"))
    # the hit counts where it is the first common token of the template, and enough tokens may follow it
    first = F.array_position("wanted", F.element_at(F.filter("wanted", lambda t: F.array_contains("tokens", t)), 1)) - 1
    pairs = pairs.where((F.col("place") == first) & (F.size("wanted") - F.col("place") >= F.col("need")))
    common = F.size(F.array_intersect("wanted", "tokens"))
    return pairs.withColumn("common", common).where("common >= need").select("doc_id", "row", "block", "label", (F.col("common") / F.size("wanted")).alias("containment"))


def wrapped_blocks(out: DataFrame) -> DataFrame:
    """All (text, template) pairs where a run of words across line ends holds enough tokens: (doc_id, row, label, containment)."""
    rows = out.where(F.size("near") > 0).select("doc_id", "row", "spread", F.explode("near").alias("t"))
    rows = rows.select("doc_id", "row", "t", F.filter("spread", lambda x: F.array_contains("t.wanted", x["token"])).alias("own"))
    run = lambda x, i: F.filter(F.slice("own", i + 1, F.col("t.words")), lambda y: y["at"] < x["at"] + F.col("t.words"))
    common = F.array_max(F.transform("own", lambda x, i: F.size(F.array_distinct(F.transform(run(x, i), lambda y: y["token"])))))
    return rows.withColumn("common", common).where("common >= t.need").select("doc_id", "row", F.col("t.label").alias("label"), (F.col("common") / F.size("t.wanted")).alias("containment"))


def phrase_places(words: list[str], label: str) -> Column:
    """Where a phrase starts in the column `words`: array<struct<at, label>>."""
    here = lambda i: F.forall(F.array(*[F.coalesce(F.get("words", i + k) == w, F.lit(False)) for k, w in enumerate(words)]), lambda x: x)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), here)
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """License phrases and template notices of every whole text.

    Returns per row (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): n_base counts the
    places of the phrases, first_word and last_word their smallest and largest start (null if none), score is
    1 where a phrase stands and else the best containment of a template (0 if under the threshold). A null text is
    empty; repeated rows are scanned each on their own; no rows give no rows; other columns are not read.
    """
    docs = pick(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    out = save(read_words(docs, templates, percent))
    blocks = out.select("doc_id", "row", F.explode("blocks").alias("b")).select("doc_id", "row", "b.block", "b.tokens")
    hits = template_blocks(blocks, ordered_templates(blocks, templates), percent).drop("block").unionByName(wrapped_blocks(out))
    found = hits.groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = out.join(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row"), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row")), "left")
    labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["at"])).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
