"""Table shape, schema, category domains and implausible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_missing, nan_to_null, trim_unicode
from .reshape import melt_categories


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def schema_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """``position``, ``column``, ``type``, ``n_null``, ``n_distinct`` (null counts as a value).

    Exact distinct counts shuffle each distinct value of each column once, as two
    short columns.  With ``exact=False`` fixed-size sketches count in one pass
    without that shuffle.
    """
    names = df.columns
    facts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
        )
        for i, c in enumerate(names, start=1)
    ]

    def clean(c: str):
        kind = df.schema[c].dataType
        # Adding zero makes -0.0 and 0.0 one value.
        return nan_to_null(F.col(c)) + 0 if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)

    if exact:
        text = df.select(*[clean(c).cast("string").alias(str(i)) for i, c in enumerate(names, 1)])
        long = text.unpivot([], text.columns, "__at", "__value")
        per_value = long.groupBy("__at", "__value").agg(F.count(F.lit(1)).alias("__n"))
        stats = per_value.groupBy(F.col("__at").cast("int").alias("__at")).agg(
            F.coalesce(F.sum(F.when(F.col("__value").isNull(), F.col("__n"))), F.lit(0)).alias(
                "n_null"
            ),
            F.count(F.lit(1)).alias("n_distinct"),
        )
        what = F.get(F.array(*facts), F.col("__at") - 1)
        return stats.select(what.alias("f"), "n_null", "n_distinct").select(
            "f.*", "n_null", "n_distinct"
        )
    stats = df.agg(
        *[F.count_if(is_missing(df, c)).alias(f"__n{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(clean(c)).alias(f"__d{i}") for i, c in enumerate(names)],
    )
    rows = [
        F.struct(
            f["position"].alias("position"),
            f["column"].alias("column"),
            f["type"].alias("type"),
            F.col(f"__n{i}").alias("n_null"),
            (F.col(f"__d{i}") + (F.col(f"__n{i}") > 0).cast("int")).alias("n_distinct"),
        )
        for i, f in enumerate(facts)
    ]
    return stats.select(F.inline(F.array(*rows)))


def category_values(
    df: DataFrame, columns: Sequence[str], trimmed: bool = False, keep_null: bool = True
) -> DataFrame:
    """``variable``, ``category``: the distinct values, raw or trimmed."""
    long = melt_categories(df, columns)
    if trimmed:
        long = long.withColumn("category", trim_unicode(F.col("category")))
    if not keep_null:
        long = long.where(F.col("category").isNotNull())
    return long.distinct().orderBy("variable", F.asc_nulls_last("category"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of one column; missing values are a row of their own, if there are any."""
    return df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def all_category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies of several columns in one pass, most frequent first."""
    counts = (
        melt_categories(df, columns)
        .groupBy("variable", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy("variable", F.desc("n"), F.asc_nulls_last("category"))


def missing_crosstab(df: DataFrame, category: str, other: str) -> DataFrame:
    """Two-way counts of a category by "other is missing"; empty cells are 0.

    Both cells of a level come from one aggregate row, so no join builds the zeros.
    """
    missing = is_missing(df, other)
    counts = df.groupBy(F.col(category).alias("category")).agg(
        F.count_if(missing).alias("yes"), F.count_if(~missing).alias("no")
    )
    cells = F.array(
        F.struct(F.lit(True).alias("other_missing"), F.col("yes").alias("n")),
        F.struct(F.lit(False).alias("other_missing"), F.col("no").alias("n")),
    )
    return counts.select("category", F.inline(cells))


def padded_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable``, ``category``, ``n``: values with whitespace at either end."""
    long = melt_categories(df, columns)
    padded = long.where(F.col("category") != trim_unicode(F.col("category")))
    return padded.groupBy("variable", "category").agg(F.count(F.lit(1)).alias("n"))


def empty_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable``, ``n``: how many values are empty once trimmed (0 where none are)."""
    counts = df.agg(*[F.count_if(trim_unicode(F.col(c)) == "").alias(c) for c in columns])
    return counts.unpivot([], list(columns), "variable", "n")


def impossible_values(
    df: DataFrame, age: str, distance: str, duration: str, target: str
) -> DataFrame:
    """One row of counters for negative and zero measurements."""
    c = F.col
    return df.agg(
        F.count_if(c(age) < 0).alias("negative_age"),
        F.count_if(c(distance) == 0).alias("zero_distance"),
        F.count_if(c(distance) < 0).alias("negative_distance"),
        F.count_if(c(duration) < 0).alias("negative_duration"),
        F.count_if(c(target) < 0).alias("negative_value"),
        F.count_if(c(target) == 0).alias("zero_value"),
    )
