"""Row-wise cleaning and features.  All narrow: no shuffle, one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    blank_to_null,
    day_name,
    implied_speed,
    is_missing,
    parse_minute,
    plausible_distance,
    time_period,
    trim_unicode,
    weekend_label,
)
from ..functions.columns import SPEED_LIMIT_KMH


def keep_categories(
    df: DataFrame, column: str, values: Sequence[str], target: str | None = None
) -> DataFrame:
    """Rows whose raw category is in ``values``; with ``target``, only where it is present."""
    kept = df.where(F.col(column).isin(*values))
    return kept if target is None else kept.where(~is_missing(df, target))


def complete_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two columns, on rows where both are present."""
    return df.where(~is_missing(df, a) & ~is_missing(df, b)).select(a, b)


def clean_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim, then turn empty strings into nulls."""
    return df.withColumns(
        {c: blank_to_null(trim_unicode(F.col(c).cast("string"))) for c in columns}
    )


def parse_times(df: DataFrame, column: str) -> DataFrame:
    """Text to timestamp; a column that already is one stays as it is."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, parse_minute(F.col(column)))
    return df


def time_features(df: DataFrame, column: str, night_fallback: bool = False) -> DataFrame:
    """Adds ``booking_hour``, ``booking_day``, ``is_weekend`` and ``time_period``."""
    ts = F.col(column)
    return df.withColumns(
        {
            "booking_hour": F.hour(ts),
            "booking_day": day_name(ts),
            "is_weekend": weekend_label(ts),
            "time_period": time_period(ts, night_fallback),
        }
    )


def flag_speed(
    df: DataFrame, distance: str, duration: str, limit: float = SPEED_LIMIT_KMH
) -> DataFrame:
    """Adds ``estimated_speed_kmh`` and the three-valued ``distance_invalid``."""
    speed = implied_speed(F.col(distance), F.col(duration))
    return df.withColumns({"estimated_speed_kmh": speed, "distance_invalid": speed > limit})


def clean_distance(
    df: DataFrame,
    distance: str,
    duration: str,
    name: str = "distance_km_clean",
    limit: float = SPEED_LIMIT_KMH,
) -> DataFrame:
    """Adds the distance, blanked where the implied speed is too high or unknown."""
    speed = implied_speed(F.col(distance), F.col(duration))
    return df.withColumn(name, plausible_distance(F.col(distance), speed, limit))


def invalid_distance_rows(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that ``flag_speed`` marks, with diagnostic columns."""
    return flagged.where(F.col("distance_invalid")).select(*columns)


def cleaning_effect(
    flagged: DataFrame, distance: str, cleaned: str = "distance_km_clean"
) -> DataFrame:
    """One row: missing before and after cleaning, missing only since cleaning (which an unknown
    speed causes too), and rows flagged as too fast."""
    return flagged.agg(
        F.count_if(is_missing(flagged, distance)).alias("missing_before"),
        F.count_if(is_missing(flagged, cleaned)).alias("missing_after"),
        F.count_if(is_missing(flagged, cleaned) & ~is_missing(flagged, distance)).alias("newly_missing"),
        F.count_if(F.col("distance_invalid")).alias("flagged"),
    )
