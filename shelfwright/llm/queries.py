"""Queries of the training-data operators: thin wrappers that read a table and shape the result."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, fingerprint, html, langid, licenses, periodic, pii
from .jaccard import jaccard_classes
from .oracles import ORACLES
from .packing import pack_documents
from .substring import remove_repeats
from .tokens import count_tokens

#: Where the public tokenizer files lie.
TOKENIZERS = "/opt"


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place; the folder that holds the public package is a parameter of this module."""
    for folder in (TOKENIZERS, "/opt/tokenizers"):
        if folder not in sys.path:
            sys.path.append(folder)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(chat.probe(spark))
    return chat.read_back(chat.format_turns(chat.as_messages(said)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_pii": op2_pii,
        "op3_packing": op3_packing,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_html_extraction": op5_html_extraction,
        "op6_license_scan": op6_license_scan,
        "op7_language_id": op7_language_id,
        "op8_fingerprints": op8_fingerprints,
        "op9_token_counts": op9_token_counts,
        "op10_decontamination": op10_decontamination,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can say; the others are held against plain versions in tests/llm."""
    return dict(ORACLES)
