"""Guessing column types from text, and listing the cells that a type cannot hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_minute, text_to_number, trim_unicode

#: Texts that stand for a truth value (fixed values).
TRUTH = ("true", "false", "yes", "no")
#: A type is below another if all its cells are cells of the other: the lattice of guesses, from
#: the narrowest up.  ``text`` is above all of them.
LATTICE = {
    "boolean": ("text",),
    "integer": ("number", "text"),
    "number": ("text",),
    "date": ("timestamp", "text"),
    "timestamp": ("text",),
    "text": (),
}
_INTEGER = r"^[+-]?[0-9]{1,18}$"
_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_STAMP = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}(:[0-5][0-9])?$"


def cell_types(text: Column) -> dict[str, Column]:
    """For each type of the lattice whether a cell holds it; cells are trimmed first."""
    cell = trim_unicode(text)
    date = cell.rlike(_DATE) & F.try_to_date(cell, "yyyy-M-d").isNotNull()
    minute = parse_minute(F.regexp_replace(cell, "T", " "))
    return {
        "boolean": F.lower(cell).isin(*TRUTH),
        "integer": cell.rlike(_INTEGER),
        "number": text_to_number(text).isNotNull(),
        "date": date,
        "timestamp": date | (cell.rlike(_STAMP) & minute.isNotNull()),
    }


def guess_types(df: DataFrame, columns: Sequence[str] | None = None, least_share: float = 1.0) -> DataFrame:
    """``variable``, ``guess``, ``n`` (cells that are not missing or blank), ``n_fit`` and
    ``n_rejected`` of each text column.

    Every cell is counted under each type that can hold it, so the guess does not depend on which
    rows come first.  Equal cells of a column are counted first and judged once, by one set of
    expressions whatever the number of columns: patterns and failing casts cost far more than
    counting.  Cells of their own, as keys are, each cross one combining shuffle.  The guess is
    the narrowest type that holds at least ``least_share`` of the cells; a column without cells
    is text.
    """
    names = [c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    order = [t for t in LATTICE if t != "text"]
    if not names:
        schema = "variable string, guess string, n bigint, n_fit bigint, n_rejected bigint"
        return df.sparkSession.createDataFrame([], schema)
    cells = [F.struct(F.lit(i).alias("at"), F.col(c).alias("cell")) for i, c in enumerate(names)]
    per_cell = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("cell").isNotNull())
        .groupBy("at", "cell")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    kinds = cell_types(F.col("cell"))
    counts = (
        per_cell.where(trim_unicode(F.col("cell")) != "")
        .groupBy("at")
        .agg(F.sum("times").alias("n"), *[F.sum(F.when(fits, F.col("times"))).alias(t) for t, fits in kinds.items()])
    )
    sums = counts.agg(
        *[
            F.coalesce(F.max(F.when(F.col("at") == i, F.col(count))), F.lit(0)).alias(f"{count}{i}")
            for i in range(len(names))
            for count in ("n", *order)
        ]
    )
    rows = []
    for i, c in enumerate(names):
        n = F.col(f"n{i}")
        guess, fit = F.lit(None).cast("string"), F.lit(None).cast("bigint")
        for t in reversed(order):
            enough = (n > 0) & (F.col(f"{t}{i}") >= n * F.lit(least_share))
            guess = F.when(enough, F.lit(t)).otherwise(guess)
            fit = F.when(enough, F.col(f"{t}{i}")).otherwise(fit)
        fit = F.coalesce(fit, n)
        rows.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.coalesce(guess, F.lit("text")).alias("guess"),
                n.alias("n"),
                fit.alias("n_fit"),
                (n - fit).alias("n_rejected"),
            )
        )
    return sums.select(F.inline(F.array(*rows)))


def rejected_cells(df: DataFrame, keys: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """``keys``, ``variable``, ``cell``, ``wanted``: every cell that is not missing or blank, but not
    of the type that ``types`` asks of its column.

    Beside a coerced table it lists what became null.  Only the rejected cells of a row are turned
    long, so a table without any gives no rows and nothing is multiplied.
    """
    entries = []
    for c, wanted in types.items():
        if wanted not in LATTICE or wanted == "text":
            raise ValueError(f"{wanted} is no type that can reject a cell")
        text = F.col(c).cast("string")
        present = text.isNotNull() & (trim_unicode(text) != "")
        bad = present & ~F.coalesce(cell_types(text)[wanted], F.lit(False))
        entries.append(
            F.when(bad, F.struct(F.lit(c).alias("variable"), text.alias("cell"), F.lit(wanted).alias("wanted")))
        )
    return df.select(*keys, F.inline(F.array_compact(F.array(*entries))))
