"""Queries over the test tables, one or more for each operator of this package."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capfilters, langid, leaks, licenses, mixing, orcids, packing, quality, shuffling, simhash, suffixes, variants, whitening
from ..sources import work_folder
from .common import table

#: Where the vocabulary files lie; None: where the package of public tokenizers says.
TOKENIZERS: str | None = None

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    if TOKENIZERS is not None:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op2_cap_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all vectors within their labels."""
    return capfilters.link_vectors(table(spark, sf, "embeddings"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash.simhash_groups(table(spark, sf, "documents"))


def op4_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each document that a document with a smaller id has in a passage of 50."""
    cut = suffixes.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(table(spark, sf, "documents"))


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the four fifths that are not held out."""
    return langid.identify(table(spark, sf, "documents"))


def op7_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    packed = packing.pack_documents(
        table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0
    )
    return packed.drop("row")


def op8_orc_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of all documents, written to ORC files and read back."""
    path = work_folder(spark)
    orcids.write_ids(table(spark, sf, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return orcids.digest(orcids.read_ids(spark, path))


def op9_external_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in random order in 40 shards."""
    return shuffling.shuffle_to_shards(table(spark, sf, "documents"), shards=40)


#: Token shares of the mix: sources alike, languages and topics as listed.
MIX = mixing.Targets(
    shares={
        "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15},
        "topic": {"general": 0.92, "legal": 0.03, "tables": 0.03, "contact": 0.02},
    },
    fraction=0.7,
)


def op10_proportional_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Chance of every document under the raked weights, and whether it is kept."""
    return mixing.mix(table(spark, sf, "documents"), MIX)


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents with the spelling that most of their neighbours have."""
    return variants.group_variants(table(spark, sf, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors on the eight leading components of their own covariance."""
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_benchmark_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages in every document."""
    return leaks.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_cap_filters": op2_cap_filters,
        "op3_simhash": op3_simhash,
        "op4_suffix_array": op4_suffix_array,
        "op5_quality_rules": op5_quality_rules,
        "op6_language_id": op6_language_id,
        "op7_best_fit": op7_best_fit,
        "op8_orc_ids": op8_orc_ids,
        "op9_external_shuffle": op9_external_shuffle,
        "op10_proportional_mix": op10_proportional_mix,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_benchmark_windows": op13_benchmark_windows,
    }
