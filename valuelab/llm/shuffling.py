"""Sharding by a two-pass external shuffle.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..sources import work_folder
from .common import staged

#: Buckets whose starts (three numbers each) are broadcast.
MOST_STARTS = 1_000_000
#: Buckets a task may hold one after the other, beyond this number of tasks.
MOST_TASKS = 100_000


def scatter(docs: DataFrame, buckets: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Pass one: ``row`` (all columns in a struct), ``hash`` and ``bucket`` of each record.

    The hash is of the seed, the id, the text and the row's number, so that rows alike in every
    column are spread too.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mark = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), text, F.monotonically_increasing_id())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark.alias("hash"))
    return packed.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))


def place(
    docs: DataFrame,
    shards: int,
    buckets: int,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``row``, ``shard`` and ``slot`` of each record: a random order of all rows, cut evenly.

    Pass one scatters rows uniformly into ``buckets`` by a seeded hash, each a task's whole input
    by its number.  Pass two shuffles each bucket by itself (Spark's ``shuffle`` is a seeded
    Fisher-Yates shuffle of an array).  Buckets follow each other, so a row's place in the whole
    order is its bucket's start plus its place there, and the shard is that place cut into
    ``shards`` equal parts: counts differ by one at most, slots have no gap.

    The shuffled buckets are a table in the shared folder, from which both the sizes and the
    places are read, so a task that runs again cannot disagree with them.
    """
    tasks = min(buckets, MOST_TASKS)
    part = F.expr(f"cast(cast(bucket as bigint) * {tasks}L div {buckets}L as int)")
    mixed = staged(
        scatter(docs, buckets, seed, id_col, text_col)
        .withColumn("part", part)
        .repartitionById(tasks, F.col("part"))
        .sortWithinPartitions("bucket", "hash")
        .groupBy("part", "bucket")
        .agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row"))
    )
    sizes = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket; the order over them is of numbers only
    before = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    starts = sizes.select("bucket", before.alias("start"), F.sum("n").over(W.partitionBy()).alias("all"))
    # Without the hint both sides would be dealt by bucket before the small one is seen to be small.
    starts = F.broadcast(starts) if buckets <= MOST_STARTS else starts
    order = mixed.join(starts, "bucket").withColumn("order", F.col("start") + F.col("at"))
    # exact integers: order * shards div n
    shard = F.expr(f"cast((`order` * {shards}L) div `all` as int)")
    first = F.expr(f"(shard * `all` + {shards - 1}L) div {shards}L")
    return order.withColumn("shard", shard).select("row", "shard", (F.col("order") - first).alias("slot"))


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``size`` (bytes of the text and 16) and ``text_crc32`` of each row, and ``more`` columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *more,
    )


def shuffle_to_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = 50_000,
    seed: int = 17,
    path: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard``, derived from the records in the files that ``write_shards`` has written.

    The law is ``rows``: counts of shards differ by one at most.  A null text counts as empty.
    Null and repeated ids are rows like others; an empty table gives an empty result.
    """
    path = write_shards(docs, path, shards, seed=seed, id_col=id_col, text_col=text_col, bucket_rows=bucket_rows)
    slot, shard = added_columns(docs)
    return keys_of(read_shards(docs, path), id_col, text_col, shard, slot).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def added_columns(docs: DataFrame) -> tuple[str, str]:
    """Names of the slot and the shard beside the caller's columns: with ``_`` added until free."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in ("slot", "shard"):
        while name in taken:
            name += "_"
        out.append(name)
    return out[0], out[1]


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The records in the files, with slot and shard; also where no file was written."""
    slot, shard = added_columns(docs)
    schema = StructType([*docs.schema.fields]).add(slot, LongType()).add(shard, IntegerType())
    return docs.sparkSession.read.schema(schema).parquet(path)


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    shards: int = 40,
    bucket_bytes: int = 64 << 20,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int | None = None,
) -> str:
    """Writes whole records to ``path`` in folders ``shard=k``, each file by slot; returns the path.

    Two passes over the records, in buckets of about ``bucket_bytes`` of text (at most
    ``bucket_rows`` rows): scatter by hash, shuffle each bucket, write it.  A bucket lies in one
    or two shards, so files are few.  Columns of the caller named ``slot`` or ``shard`` keep their
    names; see :func:`added_columns`.

    ``docs`` has to give the same rows in the same order when a task runs again, as files do.
    The order depends on the seed and on how the input is cut into partitions.
    """
    path = path or work_folder(docs.sparkSession)
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16), F.count(F.lit(1))).first()
    rows = max(1, int((total[1] or 1) * bucket_bytes / max(1, total[0] or 1)))
    buckets = max(1, -(-(total[1] or 0) // min(rows, bucket_rows or rows)))
    slot, shard = added_columns(docs)
    placed = place(docs, shards, buckets, seed, id_col, text_col)
    placed.sortWithinPartitions("shard", "slot").select(
        "row.*", F.col("slot").alias(slot), F.col("shard").alias(shard)
    ).write.partitionBy(shard).parquet(path)
    return path
