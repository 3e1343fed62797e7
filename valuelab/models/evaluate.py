"""Metrics over a table of predictions or scores; any model, or none, may have made them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import number
from ..operators.quantiles import MAX_WINDOW_ROWS, quantile_summary, quantiles_long


def high_value_threshold(train: DataFrame, target: str, p: float = 0.8, **options) -> float:
    """Quantile ``p`` of the target over the given (training) rows."""
    return quantile_summary(train, [target], [p], name=lambda c, _: "t", **options).first()["t"]


def label_high_value(
    df: DataFrame, target: str, threshold: float, name: str = "high_value"
) -> DataFrame:
    """1 where the target reaches the threshold, else 0."""
    return df.withColumn(name, (F.col(target) >= F.lit(threshold)).cast("int"))


def regression_metrics(
    df: DataFrame, label: str, predictions: dict[str, tuple[str, int]], by: Sequence[str] = ()
) -> DataFrame:
    """``by``, ``model``, n, r2, adj_r2, rmse, mae: all models in one pass.

    ``predictions`` maps a model's name to its column and number of predictors.
    """
    aggs: list[Column] = []
    for i, (column, _) in enumerate(predictions.values()):
        both = F.col(label).isNotNull() & F.col(column).isNotNull()
        y = F.when(both, F.col(label))
        e = F.col(label) - F.col(column)
        aggs += [
            F.count(e).alias(f"n{i}"),
            F.sum(e * e).alias(f"sse{i}"),
            F.avg(F.abs(e)).alias(f"mae{i}"),
            (F.var_pop(y) * F.count(y)).alias(f"sst{i}"),
        ]
    sums = df.groupBy(*by).agg(*aggs)
    rows = []
    for i, (model, (_, terms)) in enumerate(predictions.items()):
        n, lost = F.col(f"n{i}"), F.try_divide(F.col(f"sse{i}"), F.col(f"sst{i}"))
        rows.append(
            F.struct(
                F.lit(model).alias("model"),
                n.alias("n"),
                (1 - lost).alias("r2"),
                (1 - F.try_divide(lost * (n - 1), n - terms - 1)).alias("adj_r2"),
                F.sqrt(F.try_divide(F.col(f"sse{i}"), n)).alias("rmse"),
                F.col(f"mae{i}").alias("mae"),
            )
        )
    return sums.select(*by, F.inline(F.array(*rows)))


def residual_bins(df: DataFrame, label: str, prediction: str, bins: int = 10) -> DataFrame:
    """Mean and spread of residuals over equal-width bins of the fitted value.

    Level means speak for linearity, level spreads for constant variance.
    """
    fitted, residual = F.col(prediction), F.col(label) - F.col(prediction)
    low, high = df.agg(F.min(fitted), F.max(fitted)).first()
    if low is None:
        number = F.lit(None).cast("bigint")
    elif low == high:
        number = F.lit(0).cast("bigint")
    else:
        cut = F.floor((fitted - F.lit(low)) / F.lit(high - low) * bins)
        number = F.least(cut, F.lit(bins - 1)).cast("bigint")
    return (
        df.where(residual.isNotNull())
        .groupBy(number.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(fitted).alias("mean_fitted"),
            F.avg(residual).alias("mean_residual"),
            F.stddev_samp(residual).alias("sd_residual"),
        )
    )


def normal_points(df: DataFrame, column: str, points: int = 100, **options) -> DataFrame:
    """``rank``, ``expected``, ``observed``: at most ``points`` points of a normal Q-Q plot.

    The points are ranks spread evenly over all n rows, the middle of each of ``points`` equal
    parts; ``observed`` is the value at exactly that rank, ``expected`` the normal quantile at
    (rank - 0.5) / n.  Residuals that are normal lie on a line.  The plot has the same size at
    any row count.  Missing values are skipped; without values there are no points.
    """
    value = number(column)
    n = df.agg(F.count(value)).first()[0]
    shown = min(points, n)
    ranks = [((2 * j + 1) * n) // (2 * shown) + 1 for j in range(shown)]
    rows = [
        (i, (i - 1) / (n - 1) if n > 1 else 0.5, NormalDist().inv_cdf((i - 0.5) / n)) for i in ranks
    ]
    marks = df.sparkSession.createDataFrame(rows, "rank bigint, p double, expected double")
    if not rows:
        return marks.select("rank", "expected", F.col("p").alias("observed"))
    values = quantiles_long(df, column, [p for _, p, _ in rows], **options)
    same = F.round(marks["p"] * (n - 1)) == F.round(values["p"] * (n - 1))
    return marks.join(values, same).select("rank", "expected", F.col("value").alias("observed"))


def classification_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1 (null where undefined)."""
    yes, hit = F.col(label) == 1, F.col(score) >= F.lit(threshold)
    c = df.groupBy(*by).agg(
        F.count_if(yes & hit).alias("tp"),
        F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def score_ranking(df: DataFrame, key: str, score: str, *shown: str) -> DataFrame:
    """Rows from the highest score down, ties by key.  A range-partitioned sort."""
    return df.select(key, score, *shown).orderBy(F.desc_nulls_last(score), F.asc(key))


def running_totals(
    df: DataFrame,
    order: str,
    amounts: Sequence[str],
    splits: int = 512,
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Adds ``{amount}_before``: the total over all rows with a smaller ``order`` value.

    ``order`` must be a unique, non-null number (aggregate by it first).  Rows are
    cut into ranges by a sketch of the order column and, if there are many, into
    equal widths within a range.  Totals run over ranges, then over parts of a
    range, then over rows of a part, so no window sees more than a small share.
    """
    probs = [i / splits for i in range(1, splits)]
    sketch, low, high, n = df.agg(
        F.percentile_approx(order, probs, 10 * splits), F.min(order), F.max(order), F.count(order)
    ).first()
    amounts = list(amounts)
    if not n:
        return df.withColumns({f"{a}_before": F.lit(0.0) for a in amounts})
    if n <= max_window_rows:
        inner = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({f"{a}_before": F.sum(a).over(inner) - F.col(a) for a in amounts})

    edges = sorted({float(s) for s in sketch if low < s <= high})
    marks = [-math.inf, *edges, math.inf]
    ranged = Bucketizer(splits=marks, inputCol=order, outputCol="__range").transform(df)
    parts = math.ceil(n / (len(edges) + 1) / max_window_rows)
    # Ends of each range, so that its width can be cut evenly.
    ends = [low, *edges, high]
    at = F.col("__range").cast("int")
    start = F.lit([float(e) for e in ends])[at]
    stop = F.lit([float(e) for e in ends])[at + 1]
    cut = F.floor(F.try_divide(F.col(order) - start, stop - start) * parts)
    part = F.coalesce(F.greatest(F.lit(0), F.least(cut, F.lit(parts - 1))), F.lit(0))
    ranged = ranged.withColumn("__part", part if parts > 1 else F.lit(0))

    def before(table: DataFrame, keys: list[str], along: str, outer: dict[str, Column]) -> DataFrame:
        run = W.partitionBy(*keys).orderBy(along).rowsBetween(W.unboundedPreceding, W.currentRow)
        return table.withColumns(
            {f"{a}_before": outer[a] + F.sum(a).over(run) - F.col(a) for a in amounts}
        )

    zero = {a: F.lit(0.0) for a in amounts}
    sums = [F.sum(a).alias(a) for a in amounts]
    of_parts = ranged.groupBy("__range", "__part").agg(*sums)
    # At most ``splits`` rows: this one window without partitions is bounded by a parameter.
    of_ranges = before(of_parts.groupBy("__range").agg(*sums), [], "__range", zero).select(
        "__range", *[F.col(f"{a}_before").alias(f"__r_{a}") for a in amounts]
    )
    of_parts = before(
        of_parts.join(F.broadcast(of_ranges), "__range"),
        ["__range"],
        "__part",
        {a: F.col(f"__r_{a}") for a in amounts},
    ).select("__range", "__part", *[F.col(f"{a}_before").alias(f"__p_{a}") for a in amounts])
    rows = ranged.join(of_parts, ["__range", "__part"])
    out = before(rows, ["__range", "__part"], order, {a: F.col(f"__p_{a}") for a in amounts})
    return out.select(*df.columns, *[f"{a}_before" for a in amounts])


def _per_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows of either class at each distinct score."""
    yes = F.col(label) == 1
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("__score"))
        .agg(
            F.count_if(yes).cast("double").alias("pos"),
            F.count_if(~yes).cast("double").alias("neg"),
        )
    )


def roc_auc(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """One row: n_positive, n_negative, auc (ties count half; null with one class only)."""
    per_score = _per_score(df, label, score)
    ranked = running_totals(per_score, "__score", ["neg"], **options)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5))
    sums = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), won.alias("w"))
    return sums.select(
        F.coalesce(F.col("p"), F.lit(0.0)).cast("bigint").alias("n_positive"),
        F.coalesce(F.col("n"), F.lit(0.0)).cast("bigint").alias("n_negative"),
        F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"),
    )


def auc_interval(df: DataFrame, label: str, score: str, level: float = 0.95, **options) -> DataFrame:
    """One row: n_positive, n_negative, auc, std_error, low, high.

    DeLong's variance: a positive's placement is the share of negatives below it, a negative's the
    share of positives above it (ties count half), and the variance of the AUC is that of the
    positives' placements over their number plus that of the negatives' over theirs.  Placements
    follow from the running totals of both classes, so nothing is ranked in one task.  The error
    is null with fewer than two rows of a class.
    """
    ranked = running_totals(_per_score(df, label, score), "__score", ["pos", "neg"], **options)
    sizes = ranked.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    both = ranked.join(F.broadcast(sizes))  # one row
    below = F.try_divide(F.col("neg_before") + F.col("neg") * 0.5, F.col("all_neg"))
    above = F.try_divide(F.col("all_pos") - F.col("pos_before") - F.col("pos") * 0.5, F.col("all_pos"))
    sums = both.agg(
        F.coalesce(F.sum("pos"), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum("neg"), F.lit(0.0)).alias("n"),
        F.sum(F.col("pos") * below).alias("v"),
        F.sum(F.col("pos") * below * below).alias("vv"),
        F.sum(F.col("neg") * above).alias("w"),
        F.sum(F.col("neg") * above * above).alias("ww"),
    )

    def variance(total: str, squares: str, count: str) -> Column:
        n = F.col(count)
        return F.try_divide(F.try_divide(F.col(squares) - F.try_divide(F.col(total) * F.col(total), n), n - 1), n)

    z = NormalDist().inv_cdf((1 + level) / 2)
    told = sums.select(
        F.col("p").cast("bigint").alias("n_positive"),
        F.col("n").cast("bigint").alias("n_negative"),
        F.when(F.col("n") > 0, F.try_divide("v", "p")).alias("auc"),
        F.sqrt(F.greatest(variance("v", "vv", "p") + variance("w", "ww", "n"), F.lit(0.0))).alias("std_error"),
    ).withColumn("std_error", F.when((F.col("n_positive") > 1) & (F.col("n_negative") > 1), F.col("std_error")))
    half = F.col("std_error") * z
    return told.withColumns(
        {
            "low": F.when(half.isNotNull(), F.greatest(F.col("auc") - half, F.lit(0.0))),
            "high": F.when(half.isNotNull(), F.least(F.col("auc") + half, F.lit(1.0))),
        }
    )
