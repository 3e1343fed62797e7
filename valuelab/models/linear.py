"""Linear regression: design, nested steps, coefficients and diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import chi2_tail
from ..operators.split import TEST, TRAIN
from . import moments
from .evaluate import regression_metrics


#: Levels of one predictor; each becomes a column of a dense matrix on the driver.
MAX_LEVELS = 2000


@dataclass(frozen=True)
class Design:
    """Encoded predictors: dummies against the alphabetically first level, numbers as they are."""

    encoder: PipelineModel
    #: predictor -> names of its encoded columns, in order
    terms: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [n for names in self.terms.values() for n in names]

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds ``features``; rows with a missing or unseen value are left out."""
        helpers = [c for p in self.terms for c in (f"__i_{p}", f"__d_{p}")]
        return self.encoder.transform(df).drop(*helpers)

    def scorable(self) -> Column:
        """Whether a row has every predictor, and no category that the training rows lack."""
        known = self.encoder.stages[0].labelsArray if len(self.encoder.stages) > 1 else []
        text = self.encoder.stages[0].getInputCols() if len(self.encoder.stages) > 1 else []
        out = F.lit(True)
        for p in self.terms:
            out = out & F.col(p).isNotNull() & (F.lit(True) if p in text else ~F.isnan(F.col(p).cast("double")))
        for p, levels in zip(text, known, strict=True):
            out = out & F.array_contains(F.lit(list(levels)), F.col(p))
        return F.coalesce(out, F.lit(False))

    def score_all(self, df: DataFrame, predict: Callable, results: Sequence[str]) -> DataFrame:
        """``df`` with ``results`` of ``predict``: rows that cannot be scored stay, with nulls."""
        scored = predict(self.apply(df.where(self.scorable()))).select(*df.columns, *results)
        kinds = {f.name: f.dataType for f in scored.schema}
        others = df.where(~self.scorable()).select(
            "*", *[F.lit(None).cast(kinds[r]).alias(r) for r in results]
        )
        return scored.unionByName(others)

    def positions(self) -> dict[str, list[int]]:
        """Places of each predictor in the encoded vector."""
        places, at = {}, 0
        for predictor, names in self.terms.items():
            places[predictor] = list(range(at, at + len(names)))
            at += len(names)
        return places


def distinct_levels(train: DataFrame, text: Sequence[str], most: int | None = None) -> dict[str, list[str]]:
    """Levels of the text columns in alphabetical order; more than ``most`` of one are refused."""
    if not text:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(p).alias("level")) for i, p in enumerate(text)])
    found = train.select(F.inline(cells)).where(F.col("level").isNotNull()).distinct()
    out: dict[str, list[str]] = {p: [] for p in text}
    for at, level in (found if most is None else found.limit(most * len(text) + 1)).collect():
        out[text[at]].append(level)
    for p, levels in out.items():
        if most is not None and len(levels) > most:
            raise ValueError(f"{p} has over {most} levels: group them first")
    return {p: in_order(levels) for p, levels in out.items()}


def levels_table(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """The levels side by side, null where a column has no more: an indexer learns them from this."""
    schema = T.StructType([T.StructField(p, T.StringType()) for p in levels])
    return df.sparkSession.createDataFrame(list(zip_longest(*levels.values())), schema)


def in_order(levels: Iterable[str]) -> list[str]:
    """Levels as the encoder sorts them: by UTF-16 units."""
    return sorted(levels, key=lambda v: v.encode("utf-16-be", "surrogatepass"))


def fit_design(train: DataFrame, predictors: Sequence[str]) -> Design:
    """Learn the levels of all text predictors in one combining pass.

    Levels are sorted backwards, so the encoder, which drops the last one, drops the
    alphabetically first.
    """
    text = [p for p in predictors if isinstance(train.schema[p].dataType, T.StringType)]
    known = distinct_levels(train, text, MAX_LEVELS)
    indexer = StringIndexer(
        inputCols=text,
        outputCols=[f"__i_{p}" for p in text],
        stringOrderType="alphabetDesc",
        handleInvalid="skip",
    )
    dummies = OneHotEncoder(
        inputCols=[f"__i_{p}" for p in text], outputCols=[f"__d_{p}" for p in text], dropLast=True
    )
    vector = VectorAssembler(
        inputCols=[f"__d_{p}" if p in text else p for p in predictors],
        outputCol="features",
        handleInvalid="skip",
    )
    if text:
        indexer = indexer.fit(levels_table(train, known))
    encoder = Pipeline(stages=[indexer, dummies, vector] if text else [vector]).fit(train)
    labels = dict(zip(text, encoder.stages[0].labelsArray, strict=True)) if text else {}
    terms = {
        p: [f"{p}_{level}" for level in labels[p][:-1]] if p in labels else [p] for p in predictors
    }
    return Design(encoder, terms)


def fit_line(encoded: DataFrame, target: str, features: str = "features", prediction: str = "prediction"):
    """Least squares by the normal equations: one pass, sums combined in a tree."""
    return LinearRegression(
        featuresCol=features, labelCol=target, predictionCol=prediction, solver="normal"
    ).fit(encoded)


def coefficients(df: DataFrame, model: LinearRegressionModel, names: Sequence[str]) -> DataFrame:
    """``term``, estimate, std_error, t_value, p_value; the intercept first."""
    s = model.summary
    estimates = [*model.coefficients, model.intercept]
    rows = [
        (term, float(b), float(se), float(t), float(p))
        for term, b, se, t, p in zip(
            [*names, "(Intercept)"],
            estimates,
            s.coefficientStandardErrors,
            s.tValues,
            s.pValues,
            strict=True,
        )
    ]
    return df.sparkSession.createDataFrame(
        rows[-1:] + rows[:-1],
        "term string, estimate double, std_error double, t_value double, p_value double",
    )


def nested_fits(
    df: DataFrame, target: str, groups: Sequence[Sequence[str]], side: str = "dataset"
) -> list[moments.Fit]:
    """A least-squares fit after each predictor group, on the training rows.

    One pass gives the cross products of all columns; sweeping them, column after column, yields
    the model of every step.
    """
    design = fit_design(df.where(F.col(side) == TRAIN), [p for g in groups for p in g])
    places = design.positions()
    sums = moments.collect_moments(df.where(F.col(side) == TRAIN), design, target)
    return sums.fits([[i for p in group for i in places[p]] for group in groups])


def nested_steps(df: DataFrame, target: str, fits: Sequence[moments.Fit], side: str = "dataset") -> DataFrame:
    """Metrics of nested fits on both sides, gains and partial F tests per step: one pass.

    All steps predict side by side, in Arrow batches.  ``n_terms`` counts the columns
    estimated: one that adds nothing to those before it is passed over.  ``f_value`` and
    ``p_value`` say whether a step's columns explain more than chance would, beyond the step before.
    """
    models = {str(k): (f"__p{k}", len(fit.used)) for k, fit in enumerate(fits, start=1)}
    named = {name: fit for fit, (name, _) in zip(fits, models.values())}
    scored = moments.predictions(df, named, [side, target])
    m = regression_metrics(scored, target, models, [side])
    steps = m.groupBy(F.col("model").cast("int").alias("step")).agg(
        *[
            F.max(F.when(F.col(side) == name, F.col(c))).alias(f"{c}_{name.lower()}")
            for name in (TRAIN, TEST)
            for c in ("n", "r2", "adj_r2", "rmse", "mae")
        ]
    )
    tests = df.sparkSession.createDataFrame(
        [
            (k, len(fit.used), *moments.partial_f(before, fit))
            for k, (before, fit) in enumerate(zip([None, *fits], fits), start=1)
        ],
        "step int, n_terms int, f_value double, f_df1 int, f_df2 bigint, p_value double",
    )
    along = W.orderBy("step")  # one row per predictor group
    return (
        steps.join(tests, "step")
        .select(
            "step",
            "n_terms",
            *steps.columns[1:],
            (F.col("adj_r2_train") - F.lag("adj_r2_train").over(along)).alias("adj_r2_gain"),
            (F.lag("rmse_test").over(along) - F.col("rmse_test")).alias("rmse_test_gain"),
            *tests.columns[2:],
        )
        .orderBy("step")
    )


def nested_regressions(
    df: DataFrame, target: str, groups: Sequence[Sequence[str]], side: str = "dataset"
) -> DataFrame:
    """Models on growing predictor groups: :func:`nested_steps` of :func:`nested_fits`."""
    return nested_steps(df, target, nested_fits(df, target, groups, side), side)


def choose_step(steps: DataFrame, min_gain: float = 0.0, alpha: float = 0.05) -> int:
    """The last step whose columns explain more than chance would and raise adjusted R2.

    A step counts if its partial F test has a p-value below ``alpha`` and its gain is at least
    ``min_gain``; otherwise the first step stands, not the largest model by default.
    """
    rows = steps.select("step", "adj_r2_gain", "p_value").orderBy("step").collect()
    good = [
        r["step"]
        for r in rows[1:]
        if r["p_value"] is not None and r["p_value"] < alpha and (r["adj_r2_gain"] or 0) >= max(min_gain, 0.0)
    ]
    return max([rows[0]["step"], *good])


def breusch_pagan(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """One row: n, df, statistic (n * R2 of squared residuals on the predictors), p_value."""
    squared = scored.withColumn("__e2", F.pow(F.col(target) - F.col(prediction), F.lit(2.0)))
    s = fit_line(squared, "__e2", prediction="__e2_fit").summary
    n, k = s.numInstances, s.degreesOfFreedom
    df = n - k - 1
    stat = n * s.r2
    return scored.sparkSession.createDataFrame(
        [(n, df, float(stat), chi2_tail(stat, df))],
        "n bigint, df bigint, statistic double, p_value double",
    )


def _correlation(encoded: DataFrame) -> np.ndarray:
    """Correlations of the encoded columns: one pass, a columns x columns result."""
    return np.nan_to_num(Correlation.corr(encoded, "features").first()[0].toArray())


def inflation_factors(encoded: DataFrame, names: Sequence[str]) -> DataFrame:
    """``term``, ``vif``: diagonal of the inverse correlation matrix."""
    inverse = np.linalg.pinv(_correlation(encoded))
    rows = [(n, float(v)) for n, v in zip(names, np.diag(inverse), strict=True)]
    return encoded.sparkSession.createDataFrame(rows, "term string, vif double")


def cooks_distance(scored: DataFrame, key: str, target: str, prediction: str = "prediction") -> DataFrame:
    """``key``, residual, leverage, cooks_d for every training row.

    Needs only the mean, spread and correlation of the encoded columns; each row's
    leverage is then a quadratic form, computed in Arrow batches.
    """
    e = F.col(target) - F.col(prediction)
    row = scored.agg(
        Summarizer.metrics("mean", "std", "count").summary(F.col("features")).alias("s"),
        F.sum(e * e).alias("sse"),
    ).first()
    mean, sd = row["s"]["mean"].toArray(), row["s"]["std"].toArray()
    n, p = row["s"]["count"], len(mean)
    sd = np.where(sd > 0, sd, 1.0)
    inverse = np.linalg.pinv(_correlation(scored)) / np.outer(sd, sd) / (n - 1)
    mse = row["sse"] / (n - p - 1)

    @F.pandas_udf("double")
    def leverage(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            away = np.stack(x.to_numpy()) - mean if len(x) else np.empty((0, p))
            yield pd.Series(1.0 / n + np.einsum("ij,jk,ik->i", away, inverse, away, optimize=True))

    h = F.col("leverage")
    out = scored.select(
        key, e.alias("residual"), leverage(vector_to_array("features")).alias("leverage")
    )
    distance = F.col("residual") * F.col("residual") / F.lit((p + 1) * mse) * h / F.pow(1 - h, F.lit(2.0))
    return out.withColumn("cooks_d", F.when(h < 1, distance))
