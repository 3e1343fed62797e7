"""Token ids of documents in ORC files: run-length stripes, row indexes, Bloom filters on ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, staged, tasks
from .tokens import WordEncoder, kept

#: How the files are laid out: integers are run-length encoded by the format itself; a row index
#: entry and a Bloom filter entry for every 1,000 rows let readers pass over stripes and rows.
ORC = {
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes ``part``, ``doc_id`` and ``ids`` (array of int) in ascending order of the id.

    Texts are range-partitioned by id before they are encoded, so the shuffle carries text, not
    ids.  A file holds one range; ``part`` numbers the ranges.  A null text is empty: its ids
    are the end id alone.  Null ids come first; rows with one id stay rows of their own, in
    order of their text.
    """
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(WordEncoder, tokenizer)
        for batch in small_batches(batches, 2, 3 << 20):
            sizes, ids = encoder.encode_column(batch.column(2))
            ends = np.cumsum(sizes + 1)
            flat = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists], names=["part", "doc_id", "ids"]
            )

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(tasks(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
        .mapInArrow(run, "part int, doc_id long, ids array<int>")
        .write.options(**ORC)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files back, a task for each run of stripes; filters on ``doc_id`` reach the index."""
    return spark.read.schema("part int, doc_id long, ids array<int>").orc(path)


def digest(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of what was read back.

    ``start`` counts the ids of all documents before it in order of the id.  Ranges add up
    from one number each; inside a range the sum runs over the range alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                names=["part", "doc_id", "n_tokens", "ids_crc32"],
            )

    each = staged(
        rows.select("part", "doc_id", "ids").mapInArrow(
            run, "part int, doc_id long, n_tokens long, ids_crc32 long"
        )
    )
    totals = each.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per file, however many documents it holds
    before = totals.select(
        "part",
        (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias(
            "before"
        ),
    )
    inside = W.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, 0)
    return (
        each.withColumn("upto", F.sum("n_tokens").over(inside))
        .join(before, "part")
        .select(
            "doc_id",
            (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
