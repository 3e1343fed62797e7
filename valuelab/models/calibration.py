"""Scores turned into chances: isotonic regression by pooling adjacent violators.

Neighbouring groups of scores whose means fall are pooled until none do; in which order does not
matter.  So each range of scores pools its own first, and what is left are ever fewer blocks, to
which the same is done over other ranges until means rise across the ends of all ranges too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import number
from ..sources import staged

BLOCK = "low double, high double, n double, total double"
#: Blocks whose borders one expression may hold.
MOST_BLOCKS = 100_000


def pool(n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, count and total of each block after pooling rows in order of their score."""
    first, counts, totals = [], [], []
    for i, (c, t) in enumerate(zip(n.tolist(), total.tolist())):
        at = i
        while counts and totals[-1] * c >= t * counts[-1]:
            c, t, at = c + counts.pop(), t + totals.pop(), first.pop()
        first.append(at)
        counts.append(c)
        totals.append(t)
    return np.array(first, np.int64), np.array(counts), np.array(totals)


def _pooled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range of scores; rows come sorted and a batch is pooled with what is held."""
    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(4)]
        if held is not None:
            rows = [np.concatenate(p) for p in zip(held, rows)]
        if len(rows[0]) == 0:
            continue
        first, n, total = pool(rows[2], rows[3])
        last = np.r_[first[1:], len(rows[0])] - 1
        held = [rows[0][first], rows[1][last], n, total]
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["low", "high", "n", "total"])


def isotonic_blocks(df: DataFrame, label: str, score: str, partitions: int | None = None) -> DataFrame:
    """``low``, ``high``, ``n``, ``value``: ranges of scores and the mean label in each, rising.

    The least-squares fit among all that never fall with the score.  Rows are first added up per
    distinct score (a combining aggregate), which ranges of scores then pool, again over one range
    fewer each time means fall at a border.  Rows without score or label are left out; none
    gives no blocks.
    """
    y, x = number(label), number(score)
    groups = (
        df.select(x.alias("low"), y.alias("y"))
        .where("low is not null and y is not null")
        .groupBy("low")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("total"))
        .select("low", F.col("low").alias("high"), "n", "total")
    )
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = groups
    while True:
        dealt = blocks.repartitionByRange(ranges, "low").sortWithinPartitions("low")
        blocks = staged(dealt.mapInArrow(_pooled, BLOCK).withColumn("range", F.spark_partition_id()))
        if ranges == 1 or not _falls(blocks):
            break
        ranges -= 1
        blocks = blocks.drop("range")
    return blocks.select("low", "high", F.col("n").cast("bigint").alias("n"), (F.col("total") / F.col("n")).alias("value"))


def _falls(blocks: DataFrame) -> bool:
    """Whether means fall from the last block of a range to the first of the next one."""
    ends = blocks.groupBy("range").agg(
        F.min("low").alias("low"),
        F.min_by(F.struct("n", "total"), "low").alias("a"),
        F.max_by(F.struct("n", "total"), "low").alias("b"),
    )
    rows = sorted(ends.collect(), key=lambda r: r["low"])  # two blocks of each range
    return any(x["b"]["total"] * y["a"]["n"] >= y["a"]["total"] * x["b"]["n"] for x, y in zip(rows, rows[1:]))


def calibrate(df: DataFrame, blocks: DataFrame, score: str, name: str = "probability") -> DataFrame:
    """``df`` with ``name``: the value of the block a score falls into; a score between two blocks
    gets the lower one's, one below all of them the first one's.  Null where the score is.

    The borders are collected after a check that there are at most ``MOST_BLOCKS`` of them; with
    more, add scores up to coarser steps first.
    """
    rows = blocks.select("low", "value").limit(MOST_BLOCKS + 1).collect()
    if len(rows) > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks: round the scores first")
    if not rows:
        return df.withColumn(name, F.lit(None).cast("double"))
    rows = sorted(rows)
    x = number(score)
    if len(rows) == 1:
        return df.withColumn(name, F.when(x.isNotNull(), F.lit(rows[0]["value"])))
    marks = [-float("inf"), *[r["low"] for r in rows[1:]], float("inf")]
    held = df.withColumn("__x", x)
    known = Bucketizer(splits=marks, inputCol="__x", outputCol="__block", handleInvalid="keep").transform(held)
    values = F.lit([float(r["value"]) for r in rows])
    found = F.when(F.col("__x").isNotNull(), F.get(values, F.col("__block").cast("int")))
    return known.withColumn(name, found).drop("__x", "__block")
