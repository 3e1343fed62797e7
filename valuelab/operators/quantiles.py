"""Exact interpolated quantiles that stay bounded in memory at any row count.

``percentile`` is exact but keeps every distinct value of a group in one task.
Here a first pass brackets each wanted quantile with a sketch of fixed size, and
a second pass counts values: those inside a bracket one by one, everything
between two brackets as a single count.  The ranks in that short table are the
exact ranks, so the quantiles are exact.  Both passes aggregate before they
shuffle, so a group that holds a third of the rows costs no more than another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A side joined by broadcast has at most this many rows, and that is checked.
MAX_BROADCAST_ROWS = 10_000
# Distinct values that one window partition of the second pass should hold.
MAX_WINDOW_ROWS = 65_536


def collect_bounded(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> list[Row] | None:
    """All rows of ``df`` when there are at most ``limit``, else ``None``."""
    rows = df.take(limit + 1)
    return rows if len(rows) <= limit else None


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition in which a null key equals a null key."""
    return reduce(
        lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs]
    )


def bounded_side(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, list[Row] | None]:
    """``df`` as a broadcast join side when it is small enough, else as it is.

    The check runs ``df`` once; a small result is reused, not computed again.
    """
    rows = collect_bounded(df, limit)
    if rows is None:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def default_name(column: str, p: float) -> str:
    return f"{column}_p{p * 100:.10g}".replace(".", "_")


def quantile_summary(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    extra: Sequence[tuple[str, Column]] = (),
    name: Callable[[str, float], str] = default_name,
    accuracy: int = 10_000,
    approximate: bool = False,
    max_groups: int = MAX_BROADCAST_ROWS,
    max_window_rows: int = MAX_WINDOW_ROWS,
) -> DataFrame:
    """Quantiles of each column per group, with linear interpolation between ranks.

    One row per group: ``by``, the ``extra`` aggregates ``(alias, aggregate)``, then
    ``name(column, p)`` per column and probability.  Nulls and NaN are skipped; a
    group without values gets nulls.  ``extra`` is computed in the first pass.

    ``approximate=True`` stops after the sketch (relative rank error 1/accuracy).
    Up to ``max_groups`` groups the brackets are broadcast; beyond that they are
    joined by shuffle.
    """
    columns, by = list(columns), list(by)
    probs = sorted({float(p) for p in probs})
    values = [_value(c) for c in columns]
    aliases = [name(c, p) for c in columns for p in probs]
    extra_names = [alias for alias, _ in extra]
    extras = [expr.alias(alias) for alias, expr in extra]

    if approximate:
        sketches = [F.expr(f"percentile_approx({v}, {p}D, {accuracy})") for v in values for p in probs]
        named = [s.alias(a) for s, a in zip(sketches, aliases, strict=True)]
        return df.groupBy(*by).agg(*extras, *named).select(*by, *extra_names, *aliases)

    brackets = df.groupBy(*by).agg(*extras, *_bracket_aggregates(values, probs, accuracy))
    keyed = brackets.withColumnsRenamed({k: f"__{k}" for k in by})
    side, rows = bounded_side(keyed, max_groups)

    parts = 1024
    if rows is not None:
        most = max([r[f"__n{i}"] for r in rows for i in range(len(columns))], default=0)
        parts = max(1, math.ceil(10 * most / accuracy / max_window_rows)) if most > 2 * accuracy else 1

    slim = df.select(*by, *[F.expr(v).alias(f"__x{i}") for i, v in enumerate(values)])
    if by:
        joined = slim.join(side, same_keys(slim, side, [(k, f"__{k}") for k in by]))
        bound = str
    else:
        joined, only = slim, rows[0]
        bound = lambda b: _double(only[b])

    entries = _value_counts(joined, by, len(columns), len(probs), bound, parts)
    ranked = _exact_ranks(entries, by, probs, parts)
    picked = _pick(ranked, by, len(columns), probs, aliases)
    if not by:
        first_pass = {f.name: f.dataType for f in keyed.schema}
        out = picked.withColumns({a: F.lit(rows[0][a]).cast(first_pass[a]) for a in extra_names})
    else:
        picked = picked.withColumnsRenamed({k: f"__r_{k}" for k in by})
        out = side.join(
            picked, same_keys(side, picked, [(f"__{k}", f"__r_{k}") for k in by]), "left"
        )
    return out.select(*[F.col(f"__{k}").alias(k) for k in by], *extra_names, *aliases)


def _value(column: str) -> str:
    """A column as a double, NaN as null."""
    return f"nullif(cast(`{column}` AS double), double('NaN'))"


def _double(x: float | None) -> str:
    return "cast(NULL AS double)" if x is None else f"double('{x!r}')"


def _bracket_aggregates(values: Sequence[str], probs: Sequence[float], accuracy: int) -> list[Column]:
    """Count per column, and a low and a high bound around every quantile.

    The sketch errs by at most 1/accuracy of the rows; bounds are set four times
    that far from the rank.  Up to ``2 * accuracy`` values, all of them are kept.
    """
    slack = 4.0 / accuracy
    ends = [min(max(q, 0.0), 1.0) for p in probs for q in (p - slack, p + slack)]
    out: list[Column] = []
    for i, v in enumerate(values):
        sketch = f"percentile_approx({v}, array({', '.join(f'{q!r}D' for q in ends)}), {accuracy})"
        out.append(F.expr(f"count({v})").alias(f"__n{i}"))
        for j, p in enumerate(probs):
            low = f"if(count({v}) <= {2 * accuracy} OR {p - slack <= 0}, min({v}), {sketch}[{2 * j}])"
            high = f"if(count({v}) <= {2 * accuracy} OR {p + slack >= 1}, max({v}), {sketch}[{2 * j + 1}])"
            out += [F.expr(low).alias(f"__lo{i}_{j}"), F.expr(high).alias(f"__hi{i}_{j}")]
    return out


def _value_counts(
    df: DataFrame,
    by: Sequence[str],
    n_columns: int,
    n_probs: int,
    bound: Callable[[str], str],
    parts: int,
) -> DataFrame:
    """Rows per (group, column, region, part, value).

    Region 2j lies below bracket j, region 2j+1 inside it; only inside values keep
    their value.  ``part`` cuts a bracket into equal widths.  (region, part, value)
    sorts like the value itself.
    """

    def ends(i: int, j: int) -> tuple[str, str]:
        return bound(f"__lo{i}_{j}"), bound(f"__hi{i}_{j}")

    def region(i: int) -> str:
        cases = [
            f"WHEN __x{i} <= {high} THEN if(__x{i} >= {low}, {2 * j + 1}, {2 * j})"
            for j in range(n_probs)
            for low, high in [ends(i, j)]
        ]
        return f"CASE WHEN __x{i} IS NULL THEN NULL {' '.join(cases)} ELSE {2 * n_probs} END"

    def part(i: int) -> str:
        if parts == 1:
            return "0"
        cases = [
            f"WHEN __r{i} = {2 * j + 1} THEN "
            f"coalesce(least(floor(try_divide(__x{i} - {low}, {high} - {low}) * {parts}), {parts - 1}), 0)"
            for j in range(n_probs)
            for low, high in [ends(i, j)]
        ]
        return f"cast(CASE {' '.join(cases)} ELSE 0 END AS int)"

    marked = df.withColumns({f"__r{i}": F.expr(region(i)) for i in range(n_columns)})
    entry = [
        f"struct({i} AS __c, __r{i} AS __r, {part(i)} AS __s, if(__r{i} % 2 = 1, __x{i}, NULL) AS __v)"
        for i in range(n_columns)
    ]
    one = entry[0] if n_columns == 1 else f"explode(array({', '.join(entry)}))"
    long = marked.select(*by, F.expr(one).alias("__e")).where("__e.__r IS NOT NULL")
    return (
        long.select(*by, "__e.*")
        .groupBy(*by, "__c", "__r", "__s", "__v")
        .agg(F.count(F.lit(1)).alias("__f"))
    )


def _exact_ranks(entries: DataFrame, by: Sequence[str], probs: Sequence[float], parts: int) -> DataFrame:
    """Adds ``__n`` (values of the column in the group) and ``__end`` (values up to here)."""
    group = [*by, "__c"]
    whole = W.partitionBy(*group)
    if parts == 1:
        running = whole.orderBy("__r", "__v").rowsBetween(W.unboundedPreceding, W.currentRow)
        return entries.withColumns({"__end": F.sum("__f").over(running), "__n": F.sum("__f").over(whole)})

    # Counts per part first, then ranks only inside the parts that hold a wanted rank.
    running = whole.orderBy("__r", "__s").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = (
        entries.groupBy(*group, "__r", "__s")
        .agg(F.sum("__f").alias("__g"))
        .withColumns({"__upto": F.sum("__g").over(running), "__n": F.sum("__g").over(whole)})
    )
    holds = " OR ".join(_holds(rank, "__upto - __g", "__upto") for p in probs for rank in _ranks(p))
    wanted = totals.where(holds).select(
        *[F.col(k).alias(f"__w_{k}") for k in [*group, "__r", "__s"]],
        (F.col("__upto") - F.col("__g")).alias("__before"),
        "__n",
    )
    keys = [(k, f"__w_{k}") for k in [*group, "__r", "__s"]]
    inner = W.partitionBy(*group, "__r", "__s").orderBy("__v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return entries.join(wanted, same_keys(entries, wanted, keys)).withColumn(
        "__end", F.col("__before") + F.sum("__f").over(inner)
    )


def _ranks(p: float) -> tuple[str, str]:
    """Zero-based ranks of the two neighbours of quantile ``p`` among ``n`` values."""
    low = f"floor((__n - 1) * {p!r}D)"
    return low, f"least({low} + 1, __n - 1)"


def _holds(rank: str, start: str, end: str) -> str:
    return f"({start} <= {rank} AND {rank} < {end})"


def _pick(
    ranked: DataFrame, by: Sequence[str], n_columns: int, probs: Sequence[float], aliases: list[str]
) -> DataFrame:
    """The values at the wanted ranks, and the point between each two of them."""
    aggs, outs = [], []
    for i in range(n_columns):
        aggs.append(F.expr(f"max(if(__c = {i}, __n, NULL)) AS __n{i}"))
        for j, p in enumerate(probs):
            for side, rank in zip(("lo", "hi"), _ranks(p), strict=True):
                hit = f"__c = {i} AND {_holds(rank, '__end - __f', '__end')}"
                aggs.append(F.expr(f"max(if({hit}, __v, NULL)) AS __{side}{i}_{j}"))
            low, high, place = f"__lo{i}_{j}", f"__hi{i}_{j}", f"((__n{i} - 1) * {p!r}D)"
            outs.append(
                f"CASE WHEN __n{i} IS NOT NULL AND ({low} IS NULL OR {high} IS NULL) "
                "THEN cast(raise_error('quantile bracket missed its rank') AS double) "
                f"WHEN {low} = {high} THEN {low} "
                f"ELSE (1 - ({place} - floor({place}))) * {low} + ({place} - floor({place})) * {high} END"
            )
    picked = ranked.groupBy(*by).agg(*aggs)
    return picked.select(*by, *[F.expr(o).alias(a) for o, a in zip(outs, aliases, strict=True)])


def quantiles_long(
    df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (), **options
) -> DataFrame:
    """``by``, ``p``, ``value``: one row per group and probability."""
    probs = sorted({float(p) for p in probs})
    place = {p: f"__q{j}" for j, p in enumerate(probs)}
    wide = quantile_summary(df, [column], probs, by, name=lambda _, p: place[p], **options)
    pairs = [F.struct(F.lit(p).alias("p"), F.col(q).alias("value")) for p, q in place.items()]
    return wide.select(*by, F.inline(F.array(*pairs)))
