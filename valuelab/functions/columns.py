"""Scalar and aggregate Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels and limits that results must carry unchanged.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
TIME_PERIODS = (
    (0, 6, "Early Morning"),
    (6, 11, "Morning"),
    (11, 14, "Lunch"),
    (14, 17, "Afternoon"),
    (17, 21, "Evening"),
    (21, 24, "Night"),
)
SPEED_LIMIT_KMH = 50.0
UNKNOWN = "Unknown"


def nan_to_null(x: Column) -> Column:
    """NaN counts as missing everywhere here; Spark would sort it above every number."""
    return F.when(~F.isnan(x), x)


def number(name: str) -> Column:
    """A column of that name as a double, NaN as null."""
    return nan_to_null(F.col(name).cast("double"))


def finite(name: str) -> Column:
    """A column of that name as a double; what is no finite number is null."""
    x = number(name)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_number(x: Column) -> Column:
    """Numeric value of a column; anything unreadable is null.

    ``try_cast`` is needed because a plain cast raises under ANSI mode.
    """
    return nan_to_null(x.try_cast("double"))


def text_to_number(x: Column) -> Column:
    """``to_number`` for text; also refuses the ``12d`` / ``1f`` suffixes a cast accepts."""
    return F.when(~x.rlike(r"[0-9.][dDfF]\s*$"), to_number(x))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null test for a column of ``df``, also true for NaN in floating columns."""
    x = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def trim_unicode(x: Column) -> Column:
    """Strip any Unicode whitespace at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def parse_minute(x: Column) -> Column:
    """Timestamp (no zone) from text that starts with ``Y-M-D H:M``.

    One-digit fields and trailing text are accepted, anything else is null.  The
    zone-free type keeps the wall-clock hour under every session time zone.
    """
    head = F.nullif(F.regexp_extract(x, r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", 0), F.lit(""))
    return F.concat(head, F.lit(":00")).try_cast("timestamp_ntz")


def day_name(ts: Column) -> Column:
    """English day name, independent of locale; null for a missing time."""
    day = F.dayofweek(ts)
    out = F.when(day == 1, F.lit(DAY_NAMES[0]))
    for i, name in enumerate(DAY_NAMES[1:], start=2):
        out = out.when(day == i, F.lit(name))
    return out


def weekend_label(ts: Column) -> Column:
    """``Weekend`` / ``Weekday``; a missing time counts as ``Weekday``."""
    return F.when(F.dayofweek(ts).isin(1, 7), F.lit("Weekend")).otherwise(F.lit("Weekday"))


def time_period(ts: Column, night_fallback: bool = False) -> Column:
    """One of six day parts; a missing time is null, or ``Night`` with the flag."""
    hour = F.hour(ts)
    out = F.when(hour < TIME_PERIODS[0][1], F.lit(TIME_PERIODS[0][2]))
    for _, end, label in TIME_PERIODS[1:]:
        out = out.when(hour < end, F.lit(label))
    return out.otherwise(F.lit(TIME_PERIODS[-1][2])) if night_fallback else out


def implied_speed(distance_km: Column, duration_min: Column) -> Column:
    """km/h; null when either input is missing or the duration is zero."""
    return F.try_divide(distance_km, duration_min) * F.lit(60.0)


def plausible_distance(distance_km: Column, speed: Column, limit: float = SPEED_LIMIT_KMH) -> Column:
    """The distance where the speed is known and within the limit, else null.

    An unknown speed blanks the distance too, so there is no ``otherwise`` branch.
    """
    return F.when(speed <= F.lit(limit), distance_km)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over pairwise complete rows; null when either side is constant.

    Written from covariance and deviations because ``corr`` raises a division by
    zero on constant input under ANSI mode.
    """
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


def skewness_sample_sd(x: Column) -> Column:
    """Third central moment over the cubed sample standard deviation."""
    n = F.count(x).cast("double")
    return F.when(F.stddev_pop(x) > 0, F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))
