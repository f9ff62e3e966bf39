"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. A stage works on
all that the one before it kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm import decontam, jaccard, langid, packing, pii
from shelfwright.llm.common import fresh, save
from shelfwright.llm.queries import tokenizer_path

#: A document stays if one language has at least this share of its letters.
LANGUAGE_SHARE = 0.5
#: Near duplicates: words in a shingle and percentage of the union that two texts share.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, by the labelled spans of operator 7. Rejected: null texts, texts without letters,
    and texts of which no language holds half of the letters. A null lang is filled with the language found. Repeated rows are judged alike;
    rows without doc_id are judged and learned from like all others; where no row has a lang, all are rejected."""
    told, share = fresh(docs, "told"), fresh(docs, "share")
    found = langid.identify_rows(docs, langid.fit(docs), (told, share))
    kept = found.where((F.col(told) != langid.UNKNOWN) & (F.col(share) >= LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", told)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of operator 4 the document with the smallest doc_id, once (of its texts the one with the smallest hash). Documents
    without words stay, each text of a doc_id once. Rows without doc_id count as the last of a class. Of rows with equal doc_id and text
    one stays, whichever; texts of any length and columns of any name will do."""
    own, at, key = (fresh(docs, x) for x in ("own", "at", "key"))
    classes = save(jaccard.text_classes(docs, SHINGLE_WORDS, NEAR_PERCENT))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("tk").alias("c"))
    stay = classes.groupBy("component", F.when(F.col("component").isNull(), F.struct("doc_id", "tk")).alias("alone")).agg(F.min(place).alias("m"))
    stay = stay.select(F.col("m.b").alias(own), F.col("m.c").alias(at))
    rows = docs.withColumn(key, F.xxhash64("text"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(at)), "left_semi")
    if classes.groupBy("doc_id", "tk").count().where("count > 1").limit(1).count():  # whole rows are shuffled only if some repeat
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (operator 10). Null and empty texts hold none and stay; rows without doc_id are judged by their text; repeated
    rows go or stay together."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms generalised or removed (operator 2). Null texts stay null; every row stays."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences (operator 3). A null or empty text is one piece, its end id; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: The stages can't be said in SQL (learned model, tokenizer); tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
