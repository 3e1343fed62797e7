"""Missing values: counts, flags, maps and group comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import is_missing, number
from .quantiles import quantile_summary, same_keys
from .reshape import melt_categories

COMPLETE = "Complete"
INCOMPLETE = "Has Missing Data"


def missing_profile(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``by``, ``variable``, ``missing``, ``percentage``, most missing first.

    One aggregation over the table; only its one row per group is turned long.
    """
    names = list(columns or [c for c in df.columns if c not in by])
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(is_missing(df, c)).alias(c) for c in names],
    )
    long = counts.unpivot([*by, "__rows"], names, "variable", "missing")
    share = F.try_divide(F.col("missing"), F.col("__rows")) * 100
    return long.select(*by, "variable", "missing", share.alias("percentage")).orderBy(
        *by, F.desc("missing"), "variable"
    )


def missing_map(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key``, ``variable``, ``status`` (Missing / Present): a narrow reshape, no shuffle."""
    marks = [
        F.when(is_missing(df, c), F.lit("Missing")).otherwise(F.lit("Present")).alias(c)
        for c in columns
        if c != key
    ]
    return df.select(key, *marks).unpivot(
        key, [c for c in columns if c != key], "variable", "status"
    )


def missing_map_grid(df: DataFrame, key: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """``bucket``, ``variable``, ``missing``, ``present``: the map as a fixed-size grid.

    Rows fall into 16**digits buckets by the hash of their key, so the figure has
    the same size at any row count.  Counted before it is turned long.
    """
    bucket = F.substring(F.md5(F.col(key).cast("string")), 1, digits)
    counts = df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(is_missing(df, c)).alias(c) for c in columns],
    )
    long = counts.unpivot(["bucket", "__rows"], list(columns), "variable", "missing")
    return long.select(
        "bucket", "variable", "missing", (F.col("__rows") - F.col("missing")).alias("present")
    )


def percent_text(x: Column) -> Column:
    """One decimal, half to even, no trailing ``.0``."""
    return F.regexp_replace(F.bround(x, 1).cast("string"), r"\.0$", "")


def missing_labels(profile: DataFrame, names: dict[str, str]) -> DataFrame:
    """``variable``, ``label`` as "Name\\n(x.x%)" from a ``missing_profile`` result.

    A variable without a display name in ``names`` is shown by its own.
    """
    lookup = F.create_map(*[F.lit(s) for pair in names.items() for s in pair])
    shown = F.coalesce(F.try_element_at(lookup, F.col("variable")), F.col("variable"))
    label = F.concat(shown, F.lit("\n("), percent_text(F.col("percentage")), F.lit("%)"))
    return profile.select("variable", label.alias("label"))


def flag_missing(df: DataFrame, columns: Sequence[str], name: str = "has_missing") -> DataFrame:
    """Row label: any of ``columns`` missing or not."""
    any_missing = reduce(lambda a, b: a | b, [is_missing(df, c) for c in columns])
    return df.withColumn(name, F.when(any_missing, F.lit(INCOMPLETE)).otherwise(F.lit(COMPLETE)))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """``group``, ``n``, ``percentage`` of all rows; the window is over the group table."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "percentage", F.col("n") / F.sum("n").over(W.partitionBy()) * 100
    )


def compare_groups(
    df: DataFrame, group: str, target: str, others: Sequence[str], **options
) -> DataFrame:
    """Per group: n, percentage, mean and median of every column, sd of the target."""
    columns = [target, *others]
    extra = [("n", F.count(F.lit(1)))]
    extra += [(f"mean_{c}", F.avg(number(c))) for c in columns]
    extra += [(f"sd_{target}", F.stddev_samp(number(target)))]
    stats = quantile_summary(
        df, columns, [0.5], [group], extra, name=lambda c, p: f"median_{c}", **options
    )
    share = F.col("n") / F.sum("n").over(W.partitionBy()) * 100
    shown = [s for c in columns for s in (f"mean_{c}", f"median_{c}")]
    return stats.withColumn("percentage", share).select(
        group, "n", "percentage", *shown[:2], f"sd_{target}", *shown[2:]
    )


def mean_difference(
    df: DataFrame, group: str, target: str, a: str = COMPLETE, b: str = INCOMPLETE
) -> DataFrame:
    """One row: mean in ``a``, mean in ``b``, b - a, and that as a percentage of a."""
    means = df.agg(
        F.avg(F.when(F.col(group) == a, number(target))).alias("mean_a"),
        F.avg(F.when(F.col(group) == b, number(target))).alias("mean_b"),
    )
    gap = F.col("mean_b") - F.col("mean_a")
    return means.select(
        "mean_a",
        "mean_b",
        gap.alias("difference"),
        (F.try_divide(gap, F.col("mean_a")) * 100).alias("percentage_difference"),
    )


def category_shares_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``variable``, ``group``, ``category``, ``n``, ``percentage`` within variable and group."""
    counts = (
        melt_categories(df, columns, [group])
        .groupBy("variable", group, "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy(
        F.col("variable").alias("__variable"), F.col(group).alias("__group")
    ).agg(F.sum("n").alias("__total"))
    same = same_keys(counts, totals, [("variable", "__variable"), (group, "__group")])
    return counts.join(totals, same).select(
        *counts.columns, (F.col("n") / F.col("__total") * 100).alias("percentage")
    )


def category_share_gap(
    shares: DataFrame, group: str, a: str = COMPLETE, b: str = INCOMPLETE
) -> DataFrame:
    """Shares of both groups side by side and their difference, widest gap first.

    The pivot values are named, so a group without rows still has its column (0).
    """
    wide = (
        shares.groupBy("variable", "category")
        .pivot(group, [a, b])
        .agg(F.first("percentage"))
        .fillna(0.0, [a, b])
    )
    out = wide.select(
        "variable",
        "category",
        F.col(f"`{a}`").alias("share_a"),
        F.col(f"`{b}`").alias("share_b"),
        (F.col(f"`{b}`") - F.col(f"`{a}`")).alias("percentage_difference"),
    )
    return out.orderBy(
        F.desc(F.abs("percentage_difference")), "variable", F.asc_nulls_last("category")
    )


def category_gap(
    df: DataFrame, group: str, columns: Sequence[str], a: str = COMPLETE, b: str = INCOMPLETE
) -> DataFrame:
    """``variable``, ``category``, ``share_a``, ``share_b``, ``percentage_difference``, widest gap first.

    The table of :func:`category_share_gap` from one conditional aggregate: both groups are counted
    side by side per category, and the totals add up in the same small table.  A group without
    rows has shares of 0.
    """
    counts = (
        melt_categories(df, columns, [group])
        .groupBy("variable", "category")
        .agg(F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"))
        .where("n_a > 0 or n_b > 0")
    )
    totals = counts.groupBy(F.col("variable").alias("__variable")).agg(
        F.sum("n_a").alias("all_a"), F.sum("n_b").alias("all_b")
    )
    # One row per variable.
    rows = counts.join(F.broadcast(totals), F.col("variable") == F.col("__variable"))

    def share(n: str, total: str) -> Column:
        return F.coalesce(F.try_divide(F.col(n), F.col(total)) * 100, F.lit(0.0))

    out = rows.select(
        "variable", "category", share("n_a", "all_a").alias("share_a"), share("n_b", "all_b").alias("share_b")
    ).withColumn("percentage_difference", F.col("share_b") - F.col("share_a"))
    return out.orderBy(
        F.desc(F.abs("percentage_difference")), "variable", F.asc_nulls_last("category")
    )
