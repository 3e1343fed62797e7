"""Column expressions.  All of them stay inside whole-stage code generation."""

from .columns import (
    DAY_NAMES,
    TIME_PERIODS,
    UNKNOWN,
    blank_to_null,
    day_name,
    implied_speed,
    is_missing,
    nan_to_null,
    finite,
    number,
    parse_minute,
    pearson,
    plausible_distance,
    skewness_sample_sd,
    text_to_number,
    time_period,
    to_number,
    trim_unicode,
    weekend_label,
)

__all__ = [
    "DAY_NAMES",
    "TIME_PERIODS",
    "UNKNOWN",
    "blank_to_null",
    "day_name",
    "implied_speed",
    "is_missing",
    "nan_to_null",
    "finite",
    "number",
    "parse_minute",
    "pearson",
    "plausible_distance",
    "skewness_sample_sd",
    "text_to_number",
    "time_period",
    "to_number",
    "trim_unicode",
    "weekend_label",
]
