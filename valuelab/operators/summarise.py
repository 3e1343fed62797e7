"""Distribution summaries of a numeric column, overall and by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import number, pearson, skewness_sample_sd
from .quantiles import quantile_summary
from .reshape import melt_categories

EIGHT = ("n", "mean", "median", "sd", "min", "q1", "q3", "max")
_QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _basic(column: str, stat: str, strict: bool) -> Column:
    x = number(column)
    if stat == "n":
        return F.count(x)
    if stat == "n_rows":
        return F.count(F.lit(1))
    if stat == "missing":
        return F.count(F.lit(1)) - F.count(x)
    made = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}[stat](x)
    # Strict: any missing value makes the statistic missing.
    return F.when(F.count(x) == F.count(F.lit(1)), made) if strict else made


def summarise(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    stats: Sequence[str] = EIGHT,
    strict_null: bool = False,
    **options,
) -> DataFrame:
    """``by`` and the asked statistics: n, n_rows, missing, mean, median, sd, min, q1, q3, max.

    Missing values are skipped; with ``strict_null`` they make a statistic null.
    """
    return summarise_many(
        df, [column], by, stats, strict_null, name=lambda _, s: s, **options
    ).select(*by, *stats)


def summarise_many(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    stats: Sequence[str] = ("mean", "median", "sd", "min", "max"),
    strict_null: bool = False,
    name=lambda c, s: f"{c}_{s}",
    **options,
) -> DataFrame:
    """The same statistics of many columns as one wide row per group."""
    basic = [(c, s) for c in columns for s in stats if s not in _QUANTILES]
    wanted = {p: s for s, p in _QUANTILES.items() if s in stats}
    order = [name(c, s) for c in columns for s in stats]
    extra = [(name(c, s), _basic(c, s, strict_null)) for c, s in basic]
    if not wanted:
        return df.groupBy(*by).agg(*[e.alias(a) for a, e in extra]).select(*by, *order)
    if strict_null:
        extra += [(f"__whole_{c}", F.count(number(c)) == F.count(F.lit(1))) for c in columns]
    out = quantile_summary(
        df, columns, list(wanted), by, extra, name=lambda c, p: name(c, wanted[p]), **options
    )
    if strict_null:
        out = out.withColumns(
            {
                name(c, s): F.when(F.col(f"__whole_{c}"), F.col(name(c, s)))
                for c in columns
                for s in wanted.values()
            }
        )
    return out.select(*by, *order)


def by_mean(summary: DataFrame, *ties: str) -> DataFrame:
    """A summary sorted by mean from high to low."""
    return summary.orderBy(F.desc_nulls_last("mean"), *[F.asc_nulls_last(t) for t in ties])


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable``, ``category``, ``n``, ``percentage``; missing is a category."""
    counts = (
        melt_categories(df, columns)
        .groupBy("variable", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("variable").agg(F.sum("n").alias("__total"))
    # one row per named column
    return counts.join(F.broadcast(totals), "variable").select(
        *counts.columns, (F.col("n") / F.col("__total") * 100).alias("percentage")
    )


def proportions_by(
    df: DataFrame, group: str, groups: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``variable``, ``group``, ``category``, ``share`` (0 to 1) without missing values.

    Every level of a variable shows in every group, with share 0 where it has no
    row: the counts of all groups sit in one aggregate row per level.
    """
    long = melt_categories(df, columns, [group]).where(F.col("category").isNotNull())
    counts = long.groupBy("variable", "category").agg(
        *[F.count_if(F.col(group) == g).alias(f"__g{i}") for i, g in enumerate(groups)]
    )
    totals = counts.groupBy("variable").agg(
        *[F.sum(f"__g{i}").alias(f"__t{i}") for i in range(len(groups))]
    )
    cells = [
        F.struct(
            F.lit(g).alias(group),
            F.try_divide(F.col(f"__g{i}"), F.col(f"__t{i}")).alias("share"),
        )
        for i, g in enumerate(groups)
    ]
    # one row per named column
    shares = counts.join(F.broadcast(totals), "variable").select("variable", "category", F.array(*cells).alias("cells"))
    return shares.select("variable", "category", F.inline("cells")).select(
        "variable", group, "category", "share"
    )


def value_by_category(
    df: DataFrame, columns: Sequence[str], target: str, **options
) -> DataFrame:
    """n, mean and median of the target per variable and category, highest mean first."""
    long = melt_categories(df, columns, [target])
    out = quantile_summary(
        long,
        [target],
        [0.5],
        ["variable", "category"],
        [("n", F.count(F.lit(1))), ("mean", F.avg(number(target)))],
        name=lambda c, p: "median",
        **options,
    )
    return out.orderBy("variable", F.desc_nulls_last("mean"), F.asc_nulls_last("category"))


def correlations(df: DataFrame, columns: dict[str, str], target: str) -> DataFrame:
    """One row: Pearson r of each column with the target, as ``alias`` -> column."""
    return df.agg(
        *[pearson(number(c), number(target)).alias(alias) for alias, c in columns.items()]
    )


def skewness(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Third moment over the cubed sample sd."""
    return df.groupBy(*by).agg(
        F.count(number(column)).alias("n"), skewness_sample_sd(number(column)).alias("skewness")
    )


def iqr_fences(df: DataFrame, column: str, k: float = 1.5, **options) -> DataFrame:
    """One row: q1, q3, iqr, both fences, and how many values lie beyond each.

    The fences are two numbers on the driver; counting is one aggregate whose
    predicate holds constants only.
    """
    q = summarise(df, column, stats=("q1", "q3"), **options).first()
    x = number(column)
    if q["q1"] is None:
        q1 = q3 = low = high = F.lit(None).cast("double")
    else:
        iqr = q["q3"] - q["q1"]
        q1, q3 = F.lit(q["q1"]), F.lit(q["q3"])
        low, high = F.lit(q["q1"] - k * iqr), F.lit(q["q3"] + k * iqr)
    counts = df.agg(
        F.count_if(x < low).alias("n_below"), F.count_if(x > high).alias("n_above")
    )
    return counts.select(
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
        low.alias("lower_fence"),
        high.alias("upper_fence"),
        "n_below",
        "n_above",
        (F.col("n_below") + F.col("n_above")).alias("n_outliers"),
    )
