"""The numbers behind the figures: every result has a size that does not grow with rows.

Values that are no finite numbers are in no bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..functions.distributions import t_quantile
from .quantiles import bounded_side, quantile_summary, same_keys

BELOW = "Below 80th Percentile"
ABOVE = "High-value (Top 20%)"


def _range(df: DataFrame, *columns: str) -> list[tuple[float, float] | None]:
    row = df.agg(*[f(finite(c)) for c in columns for f in (F.min, F.max)]).first()
    pairs = [(row[2 * i], row[2 * i + 1]) for i in range(len(columns))]
    return [None if low is None else (low, high) for low, high in pairs]


def _bins(low: float, high: float, bins: int) -> tuple[float, int, int]:
    """Width, first and last bin number.  Bin i is centred on i * width, closed right.

    The lowest edge belongs to the first bin.
    """
    width = (high - low) / (bins - 1) if high > low else 0.1
    first = math.floor((low - width / 2) / width) + 1
    last = max(first, math.ceil((high - width / 2) / width))
    return width, first, last


def _bin_at(column: str, width: float, first: int):
    at = F.ceil((finite(column) - F.lit(width / 2)) / F.lit(width))
    return F.greatest(at, F.lit(first))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin``, ``centre``, ``n``; empty bins are listed with 0.

    One pass for the range, one for the counts.  The list of bins is a ``range`` of
    about ``bins`` numbers, joined to as many counts.
    """
    spark = df.sparkSession
    (ends,) = _range(df, column)
    if ends is None:
        return spark.createDataFrame([], "bin bigint, centre double, n bigint")
    width, first, last = _bins(*ends, bins)
    counts = (
        df.where(finite(column).isNotNull())
        .groupBy(_bin_at(column, width, first).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = spark.range(first, last + 1, numPartitions=1).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("bin") * F.lit(width)).alias("centre"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def histogram_split(df: DataFrame, column: str, p: float = 0.8, bins: int = 30) -> DataFrame:
    """A histogram with a class per bin: whether its centre reaches quantile ``p``."""
    cut = quantile_summary(df, [column], [p], name=lambda c, _: "cut").first()["cut"]
    label = F.when(F.col("centre") >= F.lit(cut).cast("double"), F.lit(ABOVE)).otherwise(
        F.lit(BELOW)
    )
    return histogram(df, column, bins).select(
        "bin", "centre", "n", label.alias("group"), F.lit(cut).cast("double").alias("threshold")
    )


def box_plot(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5, **options) -> DataFrame:
    """Per group: n, mean, q1, median, q3, whisker ends and outlier counts.

    Whiskers end at the furthest values within ``k`` times the IQR.  The quartiles
    of all groups are a checked broadcast side of the counting pass.
    """
    x = finite(value)
    boxes = quantile_summary(
        df,
        [value],
        [0.25, 0.5, 0.75],
        by,
        [("n", F.count(x)), ("mean", F.avg(x))],
        name=lambda _, p: {0.25: "q1", 0.5: "median", 0.75: "q3"}[p],
        **options,
    )
    stats = ["n", "mean", "q1", "median", "q3"]
    side, rows = bounded_side(boxes.withColumnsRenamed({c: f"__{c}" for c in by}))
    if by:
        joined = df.select(*by, x.alias("__x")).join(
            side, same_keys(df, side, [(c, f"__{c}") for c in by])
        )
    else:
        joined = df.select(
            x.alias("__x"), *[F.lit(rows[0][s]).cast("double").alias(s) for s in stats]
        )
    reach = (F.col("q3") - F.col("q1")) * k
    low, high = F.col("q1") - reach, F.col("q3") + reach
    v = F.col("__x")
    inside = v.between(low, high)
    out = joined.groupBy(*by, *stats).agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("n_outliers"),
    )
    return out.withColumn("n", F.col("n").cast("bigint"))


def box_plot_pairs(df: DataFrame, value: str, by: Sequence[str], **options) -> DataFrame:
    """Box plot over rows where the value and all categories are present."""
    return box_plot(df.dropna(subset=[value, *by]), value, by, **options)


def outliers(df: DataFrame, value: str, boxes: DataFrame, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """The rows beyond the fences of their group (the points drawn on a box plot)."""
    renamed = boxes.select(*[F.col(c).alias(f"__{c}") for c in by], "q1", "q3")
    side, rows = bounded_side(renamed)
    joined = (
        df.join(side, same_keys(df, side, [(c, f"__{c}") for c in by]))
        if by
        else df.withColumns({q: F.lit(rows[0][q]) for q in ("q1", "q3")})
    )
    reach = (F.col("q3") - F.col("q1")) * k
    x = finite(value)
    beyond = (x < F.col("q1") - reach) | (x > F.col("q3") + reach)
    return joined.where(beyond).select(*df.columns)


def density_2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """``x_bin``, ``y_bin``, ``n``: a scatter plot as counts on a grid."""
    both = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(x, y)
    ends = _range(both, x, y)
    if None in ends:
        return df.sparkSession.createDataFrame([], "x_bin bigint, y_bin bigint, n bigint")
    cells = []
    for c, (low, high) in zip((x, y), ends, strict=True):
        width, first, _ = _bins(low, high, bins)
        cells.append(_bin_at(c, width, first))
    return both.groupBy(cells[0].alias("x_bin"), cells[1].alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r2, residual standard error, mean and Sxx of x.

    Sums about the means from one aggregate over complete pairs.
    """
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    xs, ys = F.when(both, a), F.when(both, b)
    s = df.agg(
        F.count(xs).alias("n"),
        F.avg(xs).alias("x_mean"),
        F.avg(ys).alias("y_mean"),
        (F.var_pop(xs) * F.count(xs)).alias("sxx"),
        (F.var_pop(ys) * F.count(ys)).alias("syy"),
        (F.covar_pop(a, b) * F.count(xs)).alias("sxy"),
    )
    c = F.col
    slope = F.try_divide(c("sxy"), c("sxx"))
    explained = slope * c("sxy")
    return s.select(
        "n",
        slope.alias("slope"),
        (c("y_mean") - slope * c("x_mean")).alias("intercept"),
        F.try_divide(explained, c("syy")).alias("r2"),
        F.sqrt(
            F.try_divide(F.greatest(c("syy") - explained, F.lit(0.0)), F.when(c("n") > 2, c("n") - 2))
        ).alias("residual_se"),
        "x_mean",
        "sxx",
    )


def line_band(df: DataFrame, x: str, y: str, points: int = 80, level: float = 0.95) -> DataFrame:
    """``x``, ``fit``, ``low``, ``high``: the line and its confidence band on a grid."""
    fit = line_fit(df, x, y).first()
    both = df.where(finite(x).isNotNull() & finite(y).isNotNull())
    (ends,) = _range(both, x)
    if ends is None or fit["slope"] is None or fit["n"] < 3:
        return df.sparkSession.createDataFrame([], "x double, fit double, low double, high double")
    t = t_quantile(0.5 + level / 2, fit["n"] - 2)
    step = (ends[1] - ends[0]) / (points - 1)
    at = F.lit(ends[0]) + F.col("id") * F.lit(step)
    grid = df.sparkSession.range(0, points, numPartitions=1).select(at.alias("x"))
    line = F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("x")
    away = F.pow(F.col("x") - F.lit(fit["x_mean"]), F.lit(2.0)) / F.lit(fit["sxx"])
    half = F.lit(t * fit["residual_se"]) * F.sqrt(F.lit(1.0 / fit["n"]) + away)
    return grid.select(
        "x", line.alias("fit"), (line - half).alias("low"), (line + half).alias("high")
    )
