"""Filling missing values from training rows only, and aligning levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import UNKNOWN, is_missing, number
from .quantiles import collect_bounded, quantile_summary
from .reshape import melt_categories
from .split import TRAIN


def train_medians(df: DataFrame, columns: Sequence[str], side: str = "dataset") -> DataFrame:
    """One row: the exact median of each column over the training rows."""
    return quantile_summary(
        df.where(F.col(side) == TRAIN), columns, [0.5], name=lambda c, _: c
    )


def fill_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Missing numbers of both sides become the given training medians."""
    return df.withColumns(
        {
            c: F.when(is_missing(df, c), F.lit(m).cast("double")).otherwise(F.col(c))
            for c, m in medians.items()
        }
    )


def fill_unknown(df: DataFrame, columns: Sequence[str], label: str = UNKNOWN) -> DataFrame:
    return df.fillna(label, list(columns))


def restrict_levels(
    df: DataFrame, columns: Sequence[str], side: str = "dataset", max_levels: int = 10_000
) -> DataFrame:
    """Categories that no training row has become null.

    A small set of levels goes into the plan as constants; beyond ``max_levels``
    they are joined.
    """
    train = df.where(F.col(side) == TRAIN)
    levels = melt_categories(train, columns, value="level").where(F.col("level").isNotNull())
    levels = levels.distinct()
    few = collect_bounded(levels, max_levels)
    if few is not None:
        known = {c: [r["level"] for r in few if r["variable"] == c] for c in columns}
        return df.withColumns(
            {c: F.when(F.col(c).isin(values), F.col(c)) for c, values in known.items()}
        )
    for c in columns:
        mine = levels.where(F.col("variable") == c).select(
            F.col("level").alias("__level"), F.lit(True).alias("__known")
        )
        joined = df.join(mine, F.col(c) == F.col("__level"), "left")
        df = joined.withColumn(c, F.when(F.col("__known"), F.col(c))).drop("__level", "__known")
    return df


def compare_means(
    before: DataFrame, after: DataFrame, columns: Sequence[str], labels: dict[str, str]
) -> DataFrame:
    """``variable``, ``mean_value``, ``stage``: means before and after filling."""

    def means(df: DataFrame, stage: str) -> DataFrame:
        row = df.agg(*[F.avg(number(c)).alias(c) for c in columns])
        return row.unpivot([], list(columns), "variable", "mean_value").withColumn(
            "stage", F.lit(stage)
        )

    lookup = F.create_map(*[F.lit(s) for pair in labels.items() for s in pair])
    both = means(before, "Before imputation").unionByName(means(after, "After imputation"))
    return both.withColumn(
        "variable", F.coalesce(F.try_element_at(lookup, F.col("variable")), F.col("variable"))
    )
