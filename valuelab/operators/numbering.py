"""Row numbers of a whole table in a given order, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staged

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_BITS = 33


def _sort_keys(df: DataFrame, order_by: Sequence[str | Column]) -> list[Column]:
    """The order, nulls last where a name is given; then the rows' hash.

    Rows alike in the whole order get the order of their hash; those alike in all columns are
    interchangeable, and a number of their own lets a range end between them.
    """
    asked = [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order_by]
    hashed = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    return [*asked, F.asc(F.xxhash64(*hashed)), F.asc("__at")]


def row_numbers(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_number", partitions: int | None = None
) -> DataFrame:
    """``df`` with ``name``: the row's number, from 1, in the given order over the whole table.

    Rows are sorted by ranges, one range a partition, and written once with their place in it;
    the counts of the ranges, one number each, add up to where each range begins.  A value that
    many rows share is split over ranges.  Names sort ascending with nulls last; pass columns
    for another order.  Ties are numbered by a hash of the row.  An empty table gives no rows.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already")
    apart = df.withColumn("__at", F.monotonically_increasing_id())
    keys = _sort_keys(df, order_by)
    dealt = apart.repartitionByRange(*((partitions,) if partitions else ()), *keys)
    placed = staged(
        dealt.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__at", _BITS).cast("int")
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one per range
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    inside = F.col("__at").bitwiseAND((1 << _BITS) - 1)
    start = F.get(F.lit(starts), part).cast("long") if starts else F.lit(0).cast("long")
    return placed.select(*df.columns, (start + inside + 1).alias(name))
