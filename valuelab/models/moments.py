"""Linear models from cross products: one combining pass over the rows serves any number of fits.

A task turns its rows into numbers and level codes and adds up the products of all pairs of
columns, weighted if asked; two categories multiply by counting their pairs of codes, so no row
is spread over its indicator columns.  What leaves a task is one row per pair of columns, whatever
the number of rows; fits, tests and diagnostics follow from the sums on the driver, whose size is
columns x columns (at most ``MAX_COLUMNS``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_tail, f_tail, t_tail_two_sided
from ..sources import staged

if TYPE_CHECKING:
    from .linear import Design

#: Columns of a model; their products are a dense matrix on the driver.
MAX_COLUMNS = 4000
#: A column whose share of variance beside the columns before it is below this adds nothing.
ALIASED = 1e-10
#: Coded rows of at least this many predictors are packed, about this many bytes to a cell.
PACKED_FROM, CELL_BYTES = 8, 8192
PACKED = "__rows"


def levels_of(design: Design) -> dict[str, list[str]]:
    """Text predictors and their levels; the last one has no column."""
    stage = design.encoder.stages[0]
    if len(design.encoder.stages) == 1:
        return {}
    return dict(zip(stage.getInputCols(), [list(v) for v in stage.labelsArray], strict=True))


@dataclass(frozen=True)
class Coding:
    """What a task needs to turn rows into columns: predictors in order, their levels or None,
    and a number near each numeric column's values, which is subtracted to keep digits."""

    target: str
    predictors: tuple[tuple[str, tuple[str, ...] | None], ...]
    shift: tuple[float, ...]

    @property
    def columns(self) -> list[str]:
        return [p for p, _ in self.predictors]

    @property
    def widths(self) -> list[int]:
        return [1 if levels is None else len(levels) - 1 for _, levels in self.predictors]

    def rows(self, batch: pa.RecordBatch) -> tuple[Rows, np.ndarray]:
        """The batch's complete rows, and which ones those are.  Levels are text or their numbers."""
        return self._complete(self._values(batch))

    def parts(self, batch: pa.RecordBatch, most: int = 20_000) -> Iterator[Rows]:
        """The batch's complete rows, up to ``most`` at a time; the batch may hold packed rows."""
        if batch.schema.names == [PACKED]:
            records = np.frombuffer(b"".join(batch.column(0).to_pylist()), self._record)
            for low in range(0, len(records), most):
                part = records[low : low + most]
                yield self._complete([part[f] for f in self._record.names])[0]
        else:
            for low in range(0, batch.num_rows, most):
                yield self.rows(batch.slice(low, most))[0]

    def packed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch's rows as records, a few to a cell."""
        records = np.empty(batch.num_rows, self._record)
        for field, x in zip(self._record.names, self._values(batch)):
            records[field] = x
        step = max(1, CELL_BYTES // self._record.itemsize)
        cells = [records[low : low + step].tobytes() for low in range(0, len(records), step)]
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], names=[PACKED])

    @property
    def _record(self) -> np.dtype:
        kinds = ["<f8" if levels is None else "<i4" for _, levels in (*self.predictors, (self.target, None))]
        return np.dtype([(f"f{i}", kind) for i, kind in enumerate(kinds)])

    def _values(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Each column as numbers or level codes; what is missing is NaN or -1."""
        values = []
        for i, (_, levels) in enumerate((*self.predictors, (self.target, None))):
            column = batch.column(i)
            if levels is None:
                values.append(column.cast(pa.float64()).to_numpy(zero_copy_only=False))
            else:
                if not pa.types.is_integer(column.type):
                    column = pc.index_in(column, value_set=pa.array(levels, pa.string()))
                values.append(column.fill_null(-1).to_numpy(zero_copy_only=False))
        return values

    def _complete(self, values: list[np.ndarray]) -> tuple[Rows, np.ndarray]:
        keep = np.ones(len(values[0]), bool)
        for x, (_, levels) in zip(values, (*self.predictors, (self.target, None))):
            keep &= ~np.isnan(x) if levels is None else x >= 0
        kept = np.flatnonzero(keep)
        widths = [*self.widths, 1]
        starts = (np.cumsum(widths) - widths + 1).tolist()
        numbers, places, categories = [np.ones(len(kept))], [0], []
        for x, (_, levels), start, width in zip(values, (*self.predictors, (self.target, None)), starts, widths):
            if levels is None:
                numbers.append(x[kept] - self.shift[start])
                places.append(start)
            else:
                categories.append((start, width, x[kept].astype(np.int64)))
        return Rows(sum(widths) + 1, np.column_stack(numbers), np.array(places), categories), kept


@dataclass(frozen=True)
class Rows:
    """Rows of a matrix with one column of ones, shifted numbers and 0/1 columns of categories."""

    #: columns of the matrix
    size: int
    #: the ones, the numeric predictors and, last, the target; and their places in the matrix
    numbers: np.ndarray
    places: np.ndarray
    #: first column, number of columns and codes of each category; the last code has no column
    categories: list[tuple[int, int, np.ndarray]]

    @property
    def target(self) -> np.ndarray:
        return self.numbers[:, -1]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """The matrix times ``weights``."""
        out = self.numbers @ weights[self.places]
        for start, width, code in self.categories:
            out += np.append(weights[start : start + width], 0.0)[code]
        return out

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Sum of each column times ``weight``."""
        out = np.zeros(self.size)
        out[self.places] = weight @ self.numbers
        for start, width, code in self.categories:
            out[start : start + width] = np.bincount(code, weight, width + 1)[:width]
        return out

    def products(self, weight: np.ndarray | None = None) -> np.ndarray:
        """Sums of the products of every two columns, times ``weight``."""
        out = np.zeros((self.size, self.size))
        weighted = self.numbers if weight is None else self.numbers * weight[:, None]
        out[np.ix_(self.places, self.places)] = self.numbers.T @ weighted
        columns = np.ascontiguousarray(weighted.T)
        for i, (start, width, code) in enumerate(self.categories):
            own = slice(start, start + width)
            for place, x in zip(self.places.tolist(), columns):
                out[place, own] = out[own, place] = np.bincount(code, x, width + 1)[:width]
            out[range(start, start + width), range(start, start + width)] = out[0, own]
            for other, breadth, second in self.categories[:i]:
                shape = (width + 1, breadth + 1)
                pair = code * (breadth + 1) + second
                if shape[0] * shape[1] <= 4 * max(1000, len(pair)):
                    found = np.bincount(pair, weight, shape[0] * shape[1])
                else:  # far more pairs of levels than rows: only those that occur
                    found = np.zeros(shape[0] * shape[1])
                    np.add.at(found, pair, 1.0 if weight is None else weight)
                found = found.reshape(shape)[:width, :breadth]
                out[own, other : other + breadth] = found
                out[other : other + breadth, own] = found.T
        return out

    def form(self, a: np.ndarray) -> np.ndarray:
        """The quadratic form of each row with the symmetric matrix ``a``."""
        own = a[np.ix_(self.places, self.places)]
        out = np.einsum("ij,ij->i", self.numbers @ own, self.numbers)
        for i, (start, width, code) in enumerate(self.categories):
            beside = np.zeros((width + 1, len(self.places)))
            beside[:width] = a[start : start + width][:, self.places]
            out += 2 * np.einsum("ij,ij->i", beside[code], self.numbers)
            out += np.append(np.diag(a)[start : start + width], 0.0)[code]
            for other, breadth, second in self.categories[:i]:
                block = np.zeros((width + 1, breadth + 1))
                block[:width, :breadth] = a[start : start + width, other : other + breadth]
                out += 2 * block.ravel()[code * (breadth + 1) + second]
        return out

    def widened(self, more: Sequence[np.ndarray]) -> Rows:
        """The rows with further numbers before the target."""
        last = self.size - 1
        return Rows(
            self.size + len(more),
            np.column_stack([self.numbers[:, :-1], *more, self.target]),
            np.r_[self.places[:-1], last + np.arange(len(more) + 1)],
            self.categories,
        )


def coding(df: DataFrame, design: Design, target: str) -> Coding:
    """The coding of ``design``; shifts are the numbers of some row."""
    levels = levels_of(design)
    names = [p for p in design.terms]
    numbers = [p for p in (*names, target) if p not in levels]
    full = df.where(design.scorable() & F.col(target).isNotNull()).select(*numbers).first()
    near = {c: float(full[c]) if full is not None else 0.0 for c in numbers}
    shift = [0.0]
    for p in names:
        shift += [near[p]] if p not in levels else [0.0] * (len(levels[p]) - 1)
    shift.append(near[target])
    if len(shift) > MAX_COLUMNS:
        raise ValueError(f"the model has over {MAX_COLUMNS} columns: group rare levels first")
    return Coding(target, tuple((p, tuple(levels[p]) if p in levels else None) for p in names), tuple(shift))


def coded(df: DataFrame, code: Coding) -> DataFrame:
    """The rows with levels as numbers, written once: for fits that pass over them again.

    Handing a row to Python costs by the cell, so rows of many columns are packed: a cell of
    bytes holds some rows' records, and a pass hands over a hundredth of a cell per row.
    """
    taken = df.select(*code.columns, F.col(code.target).cast("double"))
    if len(code.columns) >= PACKED_FROM:

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield code.packed(batch)

        return staged(taken.mapInArrow(pack, f"`{PACKED}` binary"))
    fields = [f"`{p}` {'double' if levels is None else 'int'}" for p, levels in code.predictors]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for column, (_, levels) in zip(batch.columns, (*code.predictors, (code.target, None))):
                if levels is not None:
                    column = pc.index_in(column, value_set=pa.array(levels, pa.string()))
                columns.append(column.cast(pa.float64() if levels is None else pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*code.columns, code.target])

    return staged(taken.mapInArrow(run, ", ".join([*fields, f"`{code.target}` double"])))


def summed(df: DataFrame, code: Coding, size: int, add: Callable[[Rows], np.ndarray]) -> np.ndarray:
    """The sum of ``add`` (a symmetric ``size`` x ``size`` matrix) over all complete rows.

    ``add`` gets up to 20,000 rows at a time.  One pass; what tasks have added up meets in a
    combining aggregate.  Rows that lack a value are left out.  ``df`` may be :func:`coded`.
    """
    rows, columns = np.triu_indices(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for part in code.parts(batch):
                total += add(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(total[rows, columns])], names=["pair", "s"]
        )

    packed = df.columns == [PACKED]
    taken = df if packed else df.select(*code.columns, F.col(code.target).cast("double").alias("__target"))
    sums = taken.mapInArrow(run, "pair int, s double").groupBy("pair").agg(F.sum("s").alias("s"))
    found = sums.toArrow()  # columns x columns numbers
    pair, s = found["pair"].to_numpy(), found["s"].to_numpy()
    out = np.zeros((size, size))
    out[rows[pair], columns[pair]] = out[columns[pair], rows[pair]] = s
    return out


def products(df: DataFrame, code: Coding) -> np.ndarray:
    """Sums over the rows of the products of every two columns."""
    return summed(df, code, sum(code.widths) + 2, lambda rows: rows.products())


def sweep(a: np.ndarray, k: int) -> None:
    """Sweeps the symmetric matrix ``a`` on pivot ``k``, in place.

    Afterwards the swept block holds its inverse, the columns beside it the coefficients of the
    other columns on it, and the rest their products without what it explains.
    """
    pivot = a[k, k]
    column = a[:, k].copy()
    row = a[k, :] / pivot
    a -= np.outer(column, row)
    a[k, :] = row
    a[:, k] = -column / pivot
    a[k, k] = 1.0 / pivot


@dataclass(frozen=True)
class Fit:
    """Least squares on some of the columns of a coding."""

    design: Design
    code: Coding
    #: slopes of all columns, zero where a column is not used or adds nothing
    slopes: np.ndarray
    intercept: float
    #: numbers of the columns that were estimated (from 0, without the intercept)
    used: tuple[int, ...]
    n: int
    sse: float
    sst: float

    @property
    def df(self) -> int:
        return self.n - len(self.used) - 1

    def predict(self) -> Column:
        """The fitted value, of built-in expressions; null where a value is missing or a level new."""
        out, at = F.lit(self.intercept), 0
        for (name, levels), width in zip(self.code.predictors, self.code.widths):
            own = self.slopes[at : at + width]
            at += width
            if levels is None:
                x = F.col(name).cast("double")
                out = out + F.when(~F.isnan(x), x) * F.lit(float(own[0]))
            else:
                known = [F.lit(v) for pair in zip(levels, [*own.tolist(), 0.0]) for v in pair]
                out = out + F.try_element_at(F.create_map(*known), F.col(name))
        return out


@dataclass(frozen=True)
class Moments:
    """The cross products of a design's columns and target about ``code.shift``."""

    design: Design
    code: Coding
    sums: np.ndarray

    @property
    def n(self) -> int:
        return int(round(self.sums[0, 0]))

    def centred(self) -> np.ndarray:
        """Products of predictors and target about their means."""
        if self.n == 0:
            return np.zeros((len(self.sums) - 1,) * 2)
        mean = self.sums[0, 1:] / self.n
        return self.sums[1:, 1:] - self.n * np.outer(mean, mean)

    def means(self) -> np.ndarray:
        """Means of predictors and target."""
        return self.sums[0, 1:] / max(1, self.n) + np.asarray(self.code.shift[1:])

    def fits(self, groups: Sequence[Sequence[int]]) -> list[Fit]:
        """A fit after each group of columns joins: every column is swept once for all of them."""
        s, mean = self.centred(), self.means()
        scale = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
        a = s / np.outer(scale, scale)
        y = len(a) - 1
        used: list[int] = []
        out = []
        for group in groups:
            for k in group:
                if a[k, k] > ALIASED and s[k, k] > ALIASED * abs(self.sums[k + 1, k + 1]):
                    sweep(a, k)
                    used.append(k)
            slopes = np.zeros(y)
            slopes[used] = a[used, y] * scale[y] / scale[used]
            sse = float(max(0.0, a[y, y]) * scale[y] ** 2) if s[y, y] > 0 else 0.0
            out.append(
                Fit(
                    self.design,
                    self.code,
                    slopes,
                    float(mean[y] - slopes @ mean[:y]),
                    tuple(used),
                    self.n,
                    sse,
                    float(s[y, y]),
                )
            )
        return out

    def fit(self) -> Fit:
        return self.fits([range(len(self.sums) - 2)])[0]


def predictions(df: DataFrame, fits: dict[str, Fit], shown: Sequence[str]) -> DataFrame:
    """``shown`` and a fitted value per name, on the rows with every predictor and known levels.

    The fits have one coding: each row's levels are looked up once for all of them.
    """
    code = next(iter(fits.values())).code
    weights = [
        np.r_[fit.intercept + np.asarray(code.shift)[1:-1] @ fit.slopes, fit.slopes, 0.0] for fit in fits.values()
    ]
    first, names = len(code.columns) + 1, [*shown, *fits]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = code.rows(batch)
            taken = batch.take(pa.array(kept)).columns[first:]
            yield pa.RecordBatch.from_arrays(
                [*taken, *[pa.array(rows.dot(w)) for w in weights]], names=names
            )

    inputs = [F.col(c).alias(f"__x{i}") for i, c in enumerate(code.columns)]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in shown] + [f"`{c}` double" for c in fits]
    return df.select(*inputs, F.lit(0.0).alias("__target"), *shown).mapInArrow(run, ", ".join(fields))


def collect_moments(df: DataFrame, design: Design, target: str) -> Moments:
    """Cross products of all complete rows of ``df``: one pass."""
    code = coding(df, design, target)
    return Moments(design, code, products(df, code))


def partial_f(smaller: Fit | None, larger: Fit) -> tuple[float | None, int, int, float | None]:
    """F value, its two degrees of freedom and the chance of a larger one, for the columns that
    ``larger`` has beyond ``smaller`` (None: beyond the mean).  None where it is undefined."""
    before, terms = (larger.sst, 0) if smaller is None else (smaller.sse, len(smaller.used))
    added, rest = len(larger.used) - terms, larger.df
    if added < 1 or rest < 1 or larger.sse <= 0:
        return None, added, rest, None
    f = max(0.0, before - larger.sse) / added / (larger.sse / rest)
    return f, added, rest, f_tail(f, added, rest)


def _inverse(fit: Fit, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the intercept and the used columns, and the inverse of their products."""
    at = np.array([0, *[k + 1 for k in fit.used]])
    own = sums[np.ix_(at, at)]
    scale = np.sqrt(np.where(np.diag(own) > 0, np.diag(own), 1.0))
    return at, np.linalg.inv(own / np.outer(scale, scale)) / np.outer(scale, scale)


def _residual(fit: Fit) -> np.ndarray:
    """Weights that turn shifted columns into the residual."""
    shift = np.asarray(fit.code.shift)
    start = shift[-1] - fit.intercept - shift[1:-1] @ fit.slopes
    return np.r_[start, -fit.slopes, 1.0]


def robust_coefficients(df: DataFrame, moments: Moments, kind: str = "HC1") -> DataFrame:
    """``term``, estimate, std_error, robust_error, robust_t, robust_p; the intercept first.

    Usual errors assume one residual spread for all rows.  Robust ones are a sandwich: a second
    pass adds up the products of the columns weighted by squared residuals.  ``HC0`` takes these
    as they are, ``HC1`` times n / (n - k), ``HC2`` and ``HC3`` divide by one minus leverage, once
    and twice.  Columns that add nothing to those before them have no row.
    """
    if kind not in ("HC0", "HC1", "HC2", "HC3"):
        raise ValueError("kind is HC0, HC1, HC2 or HC3")
    fit, code = moments.fit(), moments.code
    at, bread = _inverse(fit, moments.sums)
    residual = _residual(fit)
    power = {"HC0": 0, "HC1": 0, "HC2": 1, "HC3": 2}[kind]

    inner = np.zeros_like(moments.sums)
    inner[np.ix_(at, at)] = bread

    def add(rows: Rows) -> np.ndarray:
        weight = rows.dot(residual) ** 2
        if power:
            weight = weight / np.maximum(1 - rows.form(inner), 1e-12) ** power
        return rows.products(weight)[np.ix_(at, at)]

    meat = summed(df, code, len(at), add)
    n, k = moments.n, len(at)
    cov = bread @ meat @ bread * (n / max(1, n - k) if kind == "HC1" else 1.0)
    usual = bread * (fit.sse / max(1, fit.df))
    # The intercept is that of the columns as they are, not of the shifted ones.
    back = np.eye(k)
    back[0, 1:] = -np.asarray(code.shift)[at[1:]]
    cov, usual = (back @ c @ back.T for c in (cov, usual))
    names = ["(Intercept)", *[moments.design.names[i - 1] for i in at[1:]]]
    estimates = [fit.intercept, *fit.slopes[at[1:] - 1].tolist()]
    rows = []
    for name, b, u, r in zip(names, estimates, np.diag(usual).tolist(), np.diag(cov).tolist(), strict=True):
        error = max(r, 0.0) ** 0.5
        t = b / error if error > 0 else None
        p = t_tail_two_sided(t, fit.df) if t is not None and fit.df > 0 else None
        rows.append((name, float(b), max(u, 0.0) ** 0.5, error, t, p))
    return df.sparkSession.createDataFrame(
        rows,
        "term string, estimate double, std_error double, robust_error double, robust_t double, robust_p double",
    )


def reset_test(df: DataFrame, moments: Moments, powers: Sequence[int] = (2, 3)) -> DataFrame:
    """One row: n, df1, df2, f_value, p_value of the RESET test of linearity.

    If the target is linear in the predictors, powers of the fitted value explain nothing more.
    One pass adds those powers (of the standardised fitted value) to the cross products.
    """
    fit, code = moments.fit(), moments.code
    weights = -_residual(fit)
    weights[-1] = 0.0  # fitted value minus the target's shift
    y = len(moments.sums) - 1
    middle = moments.sums[0, y] / max(1, moments.n)
    spread = ((fit.sst - fit.sse) / max(1, moments.n)) ** 0.5 or 1.0
    wanted = list(powers)

    def add(rows: Rows) -> np.ndarray:
        fitted = (rows.dot(weights) - middle) / spread
        return rows.widened([fitted**p for p in wanted]).products()

    sums = summed(df, code, y + 1 + len(wanted), add)
    wider = Moments(moments.design, _widened(code, len(wanted)), sums)
    small, large = wider.fits([range(y - 1), range(y - 1, y - 1 + len(wanted))])
    f, added, rest, p = partial_f(small, large)
    return df.sparkSession.createDataFrame(
        [(moments.n, added, rest, f, p)], "n bigint, df1 bigint, df2 bigint, f_value double, p_value double"
    )


def breusch_pagan(df: DataFrame, moments: Moments) -> DataFrame:
    """One row: n, df, statistic (n * R2 of squared residuals on the predictors), p_value.

    A second pass puts the squared residual beside the cross products.
    """
    fit, code = moments.fit(), moments.code
    residual = _residual(fit)
    size, n, terms = len(moments.sums), moments.n, len(moments.sums) - 2
    unit = (fit.sse / n if n else 0.0) or 1.0

    def add(rows: Rows) -> np.ndarray:
        squared = rows.dot(residual) ** 2 / unit
        out = np.zeros((size, size))
        out[-1, :-1] = out[:-1, -1] = rows.sums(squared)[:-1]
        out[-1, -1] = squared @ squared
        return out

    beside = summed(df, code, size, add)
    sums = moments.sums.copy()
    sums[-1], sums[:, -1] = beside[-1], beside[:, -1]
    told = Moments(moments.design, code, sums).fit()
    stat = n * (1 - told.sse / told.sst) if told.sst > 0 else float("nan")
    return df.sparkSession.createDataFrame(
        [(n, terms, float(stat), chi2_tail(stat, terms))],
        "n bigint, df bigint, statistic double, p_value double",
    )


def inflation_factors(df: DataFrame, moments: Moments) -> DataFrame:
    """``term``, ``vif``: diagonal of the inverse correlation matrix."""
    values = np.diag(np.linalg.pinv(_correlation(moments))).tolist()
    return df.sparkSession.createDataFrame(list(zip(moments.design.names, values, strict=True)), "term string, vif double")


def _correlation(moments: Moments) -> np.ndarray:
    """Correlations of the predictors' columns; zero beside a column that does not vary, one on the diagonal."""
    s = moments.centred()[:-1, :-1]
    spread = np.diag(s) > ALIASED * np.abs(np.diag(moments.sums)[1:-1])
    scale = np.sqrt(np.where(spread, np.diag(s), 1.0))
    out = np.where(np.outer(spread, spread), s / np.outer(scale, scale), 0.0)
    np.fill_diagonal(out, 1.0)
    return out


def cooks_distance(df: DataFrame, moments: Moments, key: str) -> DataFrame:
    """``key``, residual, leverage, cooks_d for every complete row of ``df``.

    A row's leverage is a quadratic form of its columns about their means with the inverse
    products, looked up by codes in Arrow batches.
    """
    fit, code = moments.fit(), moments.code
    residual, n, terms = _residual(fit), moments.n, len(moments.sums) - 2
    s = moments.centred()[:-1, :-1]
    scale = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
    inverse = np.linalg.pinv(_correlation(moments)) / np.outer(scale, scale)
    # (x - mean)' inverse (x - mean) as one form of (1, x)
    mean = moments.sums[0, 1:-1] / max(1, n)
    size = len(moments.sums)
    form = np.zeros((size, size))
    form[1:-1, 1:-1] = inverse
    form[0, 1:-1] = form[1:-1, 0] = -(inverse @ mean)
    form[0, 0] = mean @ inverse @ mean + 1.0 / max(1, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = code.rows(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.num_columns - 1).take(pa.array(kept)), pa.array(rows.dot(residual)), pa.array(rows.form(form))],
                names=[key, "residual", "leverage"],
            )

    taken = df.select(*code.columns, F.col(code.target).cast("double").alias("__target"), F.col(key).alias("__key"))
    kind = df.schema[key].dataType.simpleString()
    out = taken.mapInArrow(run, f"`{key}` {kind}, residual double, leverage double")
    mse = fit.sse / (n - terms - 1) if n - terms - 1 else float("nan")
    h, e = F.col("leverage"), F.col("residual")
    distance = e * e / F.lit((terms + 1) * mse) * h / F.pow(1 - h, F.lit(2.0))
    return out.withColumn("cooks_d", F.when(h < 1, distance))


def _widened(code: Coding, more: int) -> Coding:
    """The coding with ``more`` unshifted numeric columns before the target."""
    extra = tuple((f"__power{i}", None) for i in range(more))
    return Coding(code.target, code.predictors + extra, (*code.shift[:-1], *([0.0] * more), code.shift[-1]))


def collinearity(df: DataFrame, moments: Moments, centred: bool = False) -> DataFrame:
    """``component``, ``eigenvalue``, ``condition_index``, ``term``, ``share`` of every component and term.

    Eigenvalues of the scaled cross products, the largest first.  A component with a large
    condition index (10 is noticeable, 30 severe) is a near dependence; the terms with a large
    share of their variance in it are the ones that take part.  With the intercept as a column
    of its own, or with centred columns and without it.
    """
    names = moments.design.names
    if centred:
        own = moments.centred()[:-1, :-1]
    else:
        raw = np.eye(len(moments.sums) - 1)
        raw[0, 1:] = np.asarray(moments.code.shift)[1:-1]
        own = raw.T @ moments.sums[:-1, :-1] @ raw
        names = ["(Intercept)", *names]
    some = np.flatnonzero(np.diag(own) > 0)
    own = own[np.ix_(some, some)]
    scale = np.sqrt(np.diag(own))
    values, vectors = np.linalg.eigh(own / np.outer(scale, scale))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    part = vectors**2 / np.maximum(values, 1e-300)
    share = part / part.sum(axis=1, keepdims=True)
    rows = [
        (
            j + 1,
            float(values[j]),
            float((values[0] / values[j]) ** 0.5) if values[j] > 0 else None,
            names[k],
            float(share[i, j]),
        )
        for j in range(len(values))
        for i, k in enumerate(some.tolist())
    ]
    return df.sparkSession.createDataFrame(
        rows, "component int, eigenvalue double, condition_index double, term string, share double"
    )
