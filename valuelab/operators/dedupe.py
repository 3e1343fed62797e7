"""Duplicate keys: counting, listing, and keeping the first row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import same_keys


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: ``rows``, ``distinct_keys``, ``surplus`` (rows beyond the first per key).

    A null key counts as one key value.  Keys are counted in two aggregations, so
    a hot key is combined before the shuffle.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("surplus"),
    )


def duplicate_rows(df: DataFrame, key: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Every row whose key occurs more than once, sorted by key.

    The repeated keys come from an aggregate and filter the table by semi-join; a
    window over the key would put all rows of a hot key in one task.
    """
    repeated = (
        df.groupBy(F.col(key).alias("__key"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
    )
    rows = df.join(repeated, same_keys(df, repeated, [(key, "__key")]), "left_semi")
    return rows.orderBy(*[F.asc_nulls_last(c) for c in (key, *tie_break)])


def dedupe_first(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One whole row per key: the first by ``order_by``, which must rank rows fully.

    The filter on the row number lets Spark keep only the first row per key in each
    task before the shuffle, whatever share of the table one key has, and unused
    columns are pruned through the window.
    """
    first = W.partitionBy(key).orderBy(*order_by)
    return (
        df.withColumn("__rank", F.row_number().over(first))
        .where(F.col("__rank") == 1)
        .drop("__rank")
    )
