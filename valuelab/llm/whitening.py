"""Whitening of embeddings by the polarisation form of the covariance.

For integers y and z, ``y * z`` is half of ``(y + z)**2 - y**2 - z**2``.  So the squares of every
dimension and of every sum of two dimensions, which add up exactly in integers, give every
covariance without rounding; only the eigenvectors are floating-point numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed point of an entry: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: An entry of this size or more has no fixed-point form here (squares stay below 10**38).
LARGEST = 2.0**30
#: Components whose eigenvalue is below this share of the largest cannot be scaled to one.
FLAT = 1e-12
#: Numbers (mean and components) that one pass over the vectors carries to its tasks.
MODEL_NUMBERS = 1 << 22


def fixed_points(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``dims`` and ``x`` (longs) of the vectors that whitening takes.

    A vector that is null, empty or holds a null, NaN, infinite or larger than ``LARGEST`` entry
    is left out.
    """
    entry = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fit = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    held = vectors.select(F.col(id_col).alias("vec_id"), entry.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    return held.where(fit).select("vec_id", F.size("v").alias("dims"), x.alias("x"))


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in a batch of (dims, x): the length, the rows that have it, their matrix."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        lists = batch.column(1)
        flat = lists.flatten().to_numpy()
        start = np.cumsum(dims, dtype=np.int64) - dims
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            yield d, rows, flat[start[rows][:, None] + np.arange(d)]


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, n, sums) of each length of the task's vectors."""
    held: dict[int, list] = {}
    for d, rows, x in _matrices(batches):
        n, total = held.get(d, (0, np.zeros(d, object)))
        held[d] = (n + len(rows), total + x.sum(axis=0).astype(object))
    if held:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int32()),
                pa.array([n for n, _ in held.values()], pa.int64()),
                pa.array([[int(v) for v in t] for _, t in held.values()], pa.list_(pa.decimal128(38, 0))),
            ],
            names=["dims", "n", "sums"],
        )


def squares(y: np.ndarray) -> list[int]:
    """Exact sums over the rows of y_i**2, in order of i, then of (y_i + y_j)**2 for i < j."""
    most = int(np.abs(y).max(initial=0))
    if 4 * most * most * max(1, len(y)) >= 2**63:
        y = y.astype(object)
    out = (y * y).sum(axis=0).tolist()
    for i in range(y.shape[1] - 1):
        both = y[:, i : i + 1] + y[:, i + 1 :]
        out += (both * both).sum(axis=0).tolist()
    return [int(v) for v in out]


def _squares(centres: dict[int, np.ndarray]):
    """(dims, place, amount): the sums of :func:`squares` about whole-number centres."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for d, rows, x in _matrices(batches):
            if d not in centres:
                continue
            found = squares(x - centres[d])
            before = held.get(d)
            held[d] = found if before is None else [a + b for a, b in zip(before, found)]
        for d, amounts in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d] * len(amounts), pa.int32()),
                    pa.array(range(len(amounts)), pa.int32()),
                    pa.array(amounts, pa.decimal128(38, 0)),
                ],
                names=["dims", "place", "amount"],
            )

    return run


def covariance(n: int, rest: list[int], amounts: list[int]) -> np.ndarray:
    """Covariances (divisor ``n``) from the sums of :func:`squares`, exact up to the last division.

    ``rest`` are the sums of the values about their whole-number centres.
    """
    d = len(rest)
    v = np.empty((d, d))
    at = d
    for i in range(d):
        v[i, i] = (n * amounts[i] - rest[i] * rest[i]) / (n * n)
        for j in range(i + 1, d):
            product = (amounts[at] - amounts[i] - amounts[j]) // 2
            v[i, j] = v[j, i] = (n * product - rest[i] * rest[j]) / (n * n)
            at += 1
    return v


MODEL = (
    "dims int, n long, sums array<decimal(38,0)>, values array<double>, trace double, vectors array<double>"
)


def _solve(components: int):
    """Eigenvectors of one length's covariance; at most ``components`` of them, flat ones left out."""

    def run(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        first = totals.iloc[0]
        n, sums = int(first["n"]), [int(s) for s in first["sums"]]
        rest = [s - n * _centre(s, n) for s in sums]
        amounts = [int(a) for a in rows.sort_values("place")["amount"]]
        v = covariance(n, rest, amounts)
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = int((values[:components] > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        return pd.DataFrame(
            {
                "dims": [first["dims"]],
                "n": [n],
                "sums": [list(first["sums"])],
                "values": [values[:k].tolist()],
                "trace": [float(np.trace(v))],
                "vectors": [vectors[:, :k].T.reshape(-1).tolist()],
            }
        )

    return run


def _centre(total: int, n: int) -> int:
    """The whole number next to a mean."""
    return (2 * total + n) // (2 * n)


def fit(points: DataFrame, components: int = 8) -> DataFrame:
    """One row per vector length (``MODEL``): counts, sums and the leading components.

    ``points`` is read twice.  Each task adds its vectors up by itself, so what is shuffled is
    one row per task and pair of dimensions.  The eigenvectors of a length are found in a task.
    """
    sums = staged(
        points.select("dims", "x")
        .mapInArrow(_sums, "dims int, n long, sums array<decimal(38,0)>")
        .select("dims", "n", F.posexplode("sums").alias("place", "sum"))
        .groupBy("dims", "place")
        .agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
        .groupBy("dims")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "sum"))).alias("s"))
        .select("dims", "n", F.transform("s", lambda p: p["sum"]).alias("sums"))
    )
    amounts = None
    for block in _blocks(sums, 1):
        centres = {r.dims: np.array([_centre(int(s), r.n) for s in r.sums], np.int64) for r in block}
        part = (
            points.select("dims", "x")
            .mapInArrow(_squares(centres), "dims int, place int, amount decimal(38,0)")
            .groupBy("dims", "place")
            .agg(F.sum("amount").cast("decimal(38,0)").alias("amount"))
        )
        amounts = part if amounts is None else amounts.unionByName(part)
    if amounts is None:
        return points.sparkSession.createDataFrame([], MODEL)
    return amounts.groupBy("dims").cogroup(sums.groupBy("dims")).applyInPandas(_solve(components), MODEL)


def _blocks(lengths: DataFrame, rows_each: int, most: int = MODEL_NUMBERS) -> Iterator[list]:
    """The rows of ``lengths`` on the driver, so many at a time that ``most`` numbers are not passed.

    A length of d has ``rows_each`` times d numbers.  Usually all of them are one block; where
    there are very many lengths, each block is one more pass over the vectors.
    """
    block, held = [], 0
    for row in lengths.orderBy("dims").toLocalIterator():
        if block and held + rows_each * row.dims > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += rows_each * row.dims
    if block:
        yield block


WHITE = "vec_id {id}, dims int, n long, deviation long, whitened array<double>"


def deviations(away: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row of whole numbers; None where it passes a long."""
    most = int(np.abs(away).max(initial=0))
    if most * most * away.shape[1] < 2**63:
        return (away * away).sum(axis=1).tolist()
    exact = ((away.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def _project(models: dict[int, tuple]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            inner = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["dims", "x"])
            for d, rows, x in _matrices([inner]):
                if d not in models or not len(models[d][2]):
                    continue
                n, values, vectors, centre, off = models[d]
                y = x - centre
                # n * x - S = n * (x - centre) - (S - n * centre)
                most = int(np.abs(y).max(initial=0)) * n + max(abs(o) for o in off)
                kind = object if most >= 2**62 else np.int64
                far = deviations(y.astype(kind) * n - np.array(off, kind))
                white = (y - np.array([float(Fraction(o, n)) for o in off])) @ vectors.T / np.sqrt(values)
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array(np.full(len(rows), d, np.int32)),
                        pa.array(np.full(len(rows), n, np.int64)),
                        pa.array(far, pa.int64()),
                        pa.ListArray.from_arrays(at, pa.array(white.reshape(-1))),
                    ],
                    names=["vec_id", "dims", "n", "deviation", "whitened"],
                )

    return run


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, a, b, n, s): sums of the whitened values (b = -1) and of their products."""
    held: dict[int, list] = {}
    for batch in batches:
        dims, lists = batch.column(0).to_numpy(), batch.column(1)
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        at = at - at[0]
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            k = int(at[rows[0] + 1] - at[rows[0]])
            m = flat[at[rows][:, None] + np.arange(k)]
            n, total, products = held.get(d, (0, np.zeros(k), np.zeros((k, k))))
            held[d] = (n + len(m), total + m.sum(axis=0), products + m.T @ m)
    for d, (n, total, products) in held.items():
        k = len(total)
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d] * (len(pairs) + k), pa.int32()),
                pa.array([a for a, _ in pairs] + list(range(k)), pa.int32()),
                pa.array([b for _, b in pairs] + [-1] * k, pa.int32()),
                pa.array([n] * (len(pairs) + k), pa.int64()),
                pa.array([float(products[a, b]) for a, b in pairs] + total.tolist()),
            ],
            names=["dims", "a", "b", "n", "s"],
        )


def identity_errors(white: DataFrame) -> DataFrame:
    """``dims``, ``identity_error``: the largest entry of the whitened covariance minus the identity.

    Whitened values are centred already; the little that their means are off is taken off too.
    """
    sums = (
        white.select("dims", "whitened")
        .mapInArrow(_moments, "dims int, a int, b int, n long, s double")
        .groupBy("dims", "a", "b")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    means = sums.where("b < 0").select("dims", "a", (F.col("s") / F.col("n")).alias("mean"))
    first = means.withColumnRenamed("mean", "mean_a")
    second = means.select("dims", F.col("a").alias("b"), F.col("mean").alias("mean_b"))
    moment = F.col("s") / F.col("n") - F.col("mean_a") * F.col("mean_b")
    off = F.abs(moment - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return (
        sums.where("b >= 0")
        .join(first, ["dims", "a"])
        .join(second, ["dims", "b"])
        .groupBy("dims")
        .agg(F.max(off).alias("identity_error"))
    )


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8
) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    Entries become whole numbers x = floor(1024 * c) + 100000; n vectors with sums S are the fit
    list.  ``deviation`` is the exact sum over dimensions of (n * x - S)**2, null where that
    passes a long.  ``whitened`` is x - S / n on a unit eigenvector over the root of its
    eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest
    entry of whitened's covariance minus the identity.

    Vectors that are null, empty or hold null or non-finite entries (or entries of 2**30 and more,
    which have no fixed-point form) are left out.  Vectors of another length are a fit list of
    their own.  Directions without spread have no component, so a single vector, or equal ones,
    give no rows.  Rows that repeat an id or a vector count as often as they occur; a null id
    stays null.  An empty table gives an empty result.  Other columns are not read.

    Four passes over the numbers, none of them a shuffle of vectors.
    """
    points = staged(fixed_points(vectors, id_col, vector_col))
    kind = points.schema["vec_id"].dataType.simpleString()
    models = staged(fit(points, components))
    white = None
    for block in _blocks(models, components + 1):
        held = {}
        for r in block:
            centre = [_centre(int(s), r.n) for s in r.sums]
            held[r.dims] = (
                r.n,
                np.array(r["values"]),
                np.array(r.vectors).reshape(len(r["values"]), r.dims),
                np.array(centre, np.int64),
                [int(s) - r.n * c for s, c in zip(r.sums, centre)],
            )
        part = points.mapInArrow(_project(held), WHITE.format(id=kind))
        white = part if white is None else white.unionByName(part)
    if white is None:
        white = vectors.sparkSession.createDataFrame([], WHITE.format(id=kind))
    white = staged(white)
    shares = models.select("dims", F.transform("values", lambda e: e / F.col("trace")).alias("shares"))
    told = white.join(identity_errors(white).join(shares, "dims"), "dims")
    return told.select("*", F.posexplode("whitened").alias("place", "value")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get("shares", F.col("place")).alias("explained"),
        "identity_error",
    )
