"""From raw documents to packed sequences: five stages, each an operator of the library.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from valuelab.llm import langid, mixing, packing, simhash, suffixes  # noqa: E402
from valuelab.llm.common import staged, table  # noqa: E402
from valuelab.llm.queries import MIX, tokenizer_file  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language.  Null and letterless texts go."""
    return langid.keep_identified(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class whose fingerprints (three-word
    shingles) are linked by at most three differing bits."""
    return simhash.drop_near_copies(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has; every document stays."""
    cut = suffixes.remove_repeats(docs.select(*COLUMNS))
    return cut.select(
        F.col("id").alias("doc_id"),
        "text",
        "rest.lang",
        "rest.source",
        F.length("text").cast("long").alias("n_chars"),
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities."""
    return mixing.sample_mix(docs.select(*COLUMNS), MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row per piece."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).drop("row")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL has no fitted model and no tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
