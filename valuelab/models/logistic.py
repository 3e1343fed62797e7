"""Logistic regression on the high-value label: coefficients, odds ratios, scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import moments
from .linear import Design, fit_design


@dataclass(frozen=True)
class LogitFit:
    """Estimates of a logistic model, with their covariance."""

    line: moments.Fit
    #: covariance of the intercept and the used columns
    covariance: np.ndarray
    #: False if the iterations ended before the estimates settled (as on separated data)
    converged: bool = True

    @property
    def design(self) -> Design:
        return self.line.design

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` of the label being 1; null where a predictor is missing or new."""
        return df.withColumn("probability", 1 / (1 + F.exp(-self.line.predict())))

    def coefficients(self, df: DataFrame) -> DataFrame:
        """``term``, estimate, std_error, z_value, p_value, converged; the intercept first."""
        names = ["(Intercept)", *[self.line.design.names[k] for k in self.line.used]]
        values = [self.line.intercept, *self.line.slopes[list(self.line.used)].tolist()]
        rows = []
        for term, b, v in zip(names, values, np.diag(self.covariance).tolist(), strict=True):
            se = math.sqrt(max(v, 0.0))
            z = b / se if se > 0 else None
            p = math.erfc(abs(z) / math.sqrt(2)) if z is not None else None
            rows.append((term, b, se, z, p, self.converged))
        return df.sparkSession.createDataFrame(
            rows,
            "term string, estimate double, std_error double, z_value double, p_value double, converged boolean",
        )


class FirthFit(LogitFit):
    """Bias-reduced logistic regression: estimates are finite on separated rows too."""


def _unshifted(
    sums: moments.Moments, at: np.ndarray, scale: np.ndarray, beta: np.ndarray, inverse: np.ndarray
) -> tuple[moments.Fit, np.ndarray]:
    """The line and covariance of the columns as they are, from those of scaled and shifted ones."""
    code, used = sums.code, tuple((at[1:] - 1).tolist())
    slopes = np.zeros(sum(code.widths))
    slopes[list(used)] = beta[1:] / scale[1:]
    shift = np.asarray(code.shift)[at[1:]]
    intercept = float(beta[0] / scale[0] - shift @ slopes[list(used)])
    back = np.diag(1 / scale)
    back[0, 1:] = -shift / scale[1:]
    line = moments.Fit(sums.design, code, slopes, intercept, used, sums.n, 0.0, 0.0)
    return line, back @ inverse @ back.T


def fit_logit(
    train: DataFrame, label: str, predictors: Sequence[str], max_iter: int = 25, tolerance: float = 1e-6
) -> LogitFit:
    """Iteratively reweighted least squares on rows that have the label (0 or 1) and all predictors.

    An iteration is one combining pass over rows whose levels are numbers, written once; it starts
    from the least-squares fit.  Columns that add nothing to those before them are not estimated.
    """
    design = fit_design(train, predictors)
    code = moments.coding(train, design, label)
    rows = moments.coded(train, code)
    sums = moments.Moments(design, code, moments.products(rows, code))
    start = sums.fit()
    at = np.array([0, *[k + 1 for k in start.used]])
    k, offset = len(at), code.shift[-1]
    own = sums.sums[np.ix_(at, at)]
    scale = np.sqrt(np.where(np.diag(own) > 0, np.diag(own), 1.0) / max(1, sums.n))

    def passed(beta: np.ndarray) -> np.ndarray:
        """Information, and beside it the products with the working response."""
        weights = np.zeros(len(sums.sums))
        weights[at] = beta / scale

        def add(x: moments.Rows) -> np.ndarray:
            line = np.clip(x.dot(weights), -700, 700)
            p = np.clip(1.0 / (1.0 + np.exp(-line)), 1e-16, 1 - 1e-16)
            w = p * (1 - p)
            out = np.zeros((k + 1, k + 1))
            out[:k, :k] = x.products(w)[np.ix_(at, at)] / np.outer(scale, scale)
            out[:k, k] = out[k, :k] = x.sums(w * line + x.target + offset - p)[at] / scale
            return out

        return moments.summed(rows, code, k + 1, add)

    def plain(beta: np.ndarray) -> np.ndarray:
        line, _ = _unshifted(sums, at, scale, beta, np.zeros((k, k)))
        return np.r_[line.intercept, line.slopes]

    # The first working response is log 3 for a one and -log 3 for a zero: linear in the label.
    slopes = 2 * math.log(3) * start.slopes[list(start.used)]
    shift = np.asarray(code.shift)[at[1:]]
    first = math.log(3) * (2 * start.intercept - 1) + shift @ slopes
    beta = np.r_[first, slopes] * scale
    inverse, iterations, settled = np.zeros((k, k)), 0, sums.n == 0
    while iterations < max_iter and not settled:
        found = passed(beta)
        inverse = np.linalg.pinv(found[:k, :k], hermitian=True)
        after = inverse @ found[:k, k]
        settled = bool(np.abs(plain(after) - plain(beta)).max() < tolerance)
        beta, iterations = after, iterations + 1
    line, covariance = _unshifted(sums, at, scale, beta, inverse)
    return LogitFit(line, covariance, settled and iterations < max_iter and sums.n > 0)


def fit_firth(
    train: DataFrame, label: str, predictors: Sequence[str], max_iter: int = 60, tolerance: float = 1e-8
) -> FirthFit:
    """Firth's logistic regression on rows that have the label (0 or 1) and all predictors.

    The score of a row is its residual plus its leverage times (1/2 - p), which takes the leading
    bias away and keeps estimates finite where a predictor separates the classes.  An iteration
    is two combining passes: the information, then the score, whose leverages need it.  A step
    that lowers the penalised likelihood is halved.  Columns that add nothing to those
    before them are not estimated.  No complete row: no terms but an intercept of zero.
    """
    design = fit_design(train, predictors)
    code = moments.coding(train, design, label)
    rows = moments.coded(train, code)
    sums = moments.Moments(design, code, moments.products(rows, code))
    used = sums.fit().used
    at = np.array([0, *[k + 1 for k in used]])
    k, offset = len(at), code.shift[-1]
    own = sums.sums[np.ix_(at, at)]
    scale = np.sqrt(np.where(np.diag(own) > 0, np.diag(own), 1.0) / max(1, sums.n))

    def passed(beta: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
        """Information and log likelihood at ``beta``; the score alone if ``inverse``, for its leverages, is given."""
        weights, inner = np.zeros(len(sums.sums)), np.zeros_like(sums.sums)
        weights[at] = beta / scale
        if inverse is not None:
            inner[np.ix_(at, at)] = inverse / np.outer(scale, scale)

        def add(x: moments.Rows) -> np.ndarray:
            y = x.target + offset
            line = np.clip(x.dot(weights), -700, 700)
            p = 1.0 / (1.0 + np.exp(-line))
            w = p * (1 - p)
            out = np.zeros((k + 1, k + 1))
            if inverse is not None:
                out[:k, k] = out[k, :k] = x.sums(y - p + w * x.form(inner) * (0.5 - p))[at] / scale
                return out
            out[:k, :k] = x.products(w)[np.ix_(at, at)] / np.outer(scale, scale)
            out[k, k] = (y * line - np.logaddexp(0, line)).sum()
            return out

        return moments.summed(rows, code, k + 1, add)

    def at_estimates(beta: np.ndarray) -> tuple[np.ndarray, float]:
        found = passed(beta)
        return np.linalg.pinv(found[:k, :k]), found[k, k] + np.linalg.slogdet(found[:k, :k])[1] / 2

    beta, inverse, converged = np.zeros(k), np.zeros((k, k)), False
    if sums.n:
        inverse, height = at_estimates(beta)
        for _ in range(max_iter):
            step = inverse @ passed(beta, inverse)[:k, k]
            for _ in range(20):
                lower, further = at_estimates(beta + step)
                if further >= height - 1e-9 * abs(height):
                    break
                step = step / 2
            beta, inverse, height = beta + step, lower, further
            if np.abs(step).max() < tolerance:
                converged = True
                break
    line, covariance = _unshifted(sums, at, scale, beta, inverse)
    return FirthFit(line, covariance, converged)


def odds_ratios(coefficients: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """``term``, ``odds_ratio`` and its 95% interval."""
    b, se = F.col("estimate"), F.col("std_error")
    return coefficients.select(
        "term",
        F.exp(b).alias("odds_ratio"),
        F.exp(b - se * z).alias("low"),
        F.exp(b + se * z).alias("high"),
        "p_value",
    )
