"""Wide to long, stacking and level sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantile_summary


def melt_categories(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    variable: str = "variable",
    value: str = "category",
) -> DataFrame:
    """``keep``, variable, value: one row per input row and column; null values stay.

    Only the asked columns are read.  Aggregate right after it: rows multiply by
    the number of columns, and the partial aggregation takes that back.
    """
    slim = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return slim.unpivot(list(keep), list(columns), variable, value)


def stack(frames: dict[str, DataFrame], label: str = "dataset") -> DataFrame:
    """Tables under each other, with the name of each in ``label``."""
    named = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def union_levels(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable``, ``level``: distinct non-null values found in either table."""
    both = melt_categories(a, columns, value="level").unionByName(
        melt_categories(b, columns, value="level")
    )
    return both.where(F.col("level").isNotNull()).distinct()


def factor_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable``, ``level``, ``idx`` (from 1, alphabetical); nulls have no level."""
    levels = (
        melt_categories(df, columns, value="level").where(F.col("level").isNotNull()).distinct()
    )
    return levels.withColumn("idx", F.row_number().over(W.partitionBy("variable").orderBy("level")))


def levels_by_median(df: DataFrame, category: str, value: str, **options) -> DataFrame:
    """``category``, ``median``: levels from the highest median down, ties by name."""
    some = df.where(F.col(category).isNotNull())
    out = quantile_summary(some, [value], [0.5], [category], name=lambda c, p: "median", **options)
    return out.orderBy(F.desc_nulls_last("median"), F.asc(category))
