"""Helpers that several operators share: text buffers, runs of equal keys, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files go at once.

    Without that, they stay on the executors' disks until the driver collects garbage.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        return sources.staged(df)
    finally:
        conf.set(setting, before)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(at))
        if int(sizes.sum()) != int(at[-1] - at[0]):
            return text_buffer(column.fill_null(b""))
    return whole[at[0] : at[-1]], at - at[0]


def small_batches(
    batches: Iterable[pa.RecordBatch], text_at: int, most: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``most`` bytes of text (or one row), to bound memory."""
    for batch in batches:
        _, at = text_buffer(batch.column(text_at))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def complete_runs(
    batches: Iterable[pa.RecordBatch], key: str, least: int = 50_000
) -> Iterator[pa.Table]:
    """Pieces of sorted rows such that no value of ``key`` is cut between two pieces.

    Only the rows of an unfinished key and ``least`` rows more wait in memory, so a key's
    size has to be bounded by who deals the rows.
    """
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        joined = pa.Table.from_batches(waiting).combine_chunks()
        keys = joined[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield joined.slice(0, cut)
            waiting = joined.slice(cut).combine_chunks().to_batches()
            rows = joined.num_rows - cut
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def spanning_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` nodes the least node that edges ``a``-``b`` connect it to."""
    labels = np.arange(n) if labels is None else labels
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` for every node of ``edges`` (columns ``a``, ``b``, longs).

    The component is the least node that can be reached.  Alternating star contraction:
    each round hangs every node's larger neighbours, then its smaller ones, below the least
    node it sees, which takes about the logarithm of the longest chain in rounds.  Each round
    is a table in the shared folder, so a lost executor costs a re-read.  Nulls and loops are
    ignored.  Raises if ``max_rounds`` is not enough.
    """
    now = staged(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), "a", "b")
        .where("a is not null and b is not null and hi <> lo")
        .select("hi", "lo")
        .distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first())

    seen = mark(now)
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(
            now.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = (
            both.where("y > x")
            .join(least, "x")
            .select(F.col("y").alias("hi"), F.least("m", "x").alias("lo"))
            .distinct()
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .select(F.inline(F.expr("array(struct(hi as hi, m as lo), struct(lo as hi, m as lo))")))
            .where("hi <> lo")
            .distinct()
        )
        now = staged(small)
        found = mark(now)
        if found == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        seen = found
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
