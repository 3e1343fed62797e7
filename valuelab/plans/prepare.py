"""The preparation steps in their order, each from the one before.

bookings -> typed -> service_rows -> basket -> enriched -> model_table -> split_table -> imputed
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.dedupe import dedupe_first
from ..operators.impute import fill_medians, fill_unknown, restrict_levels, train_medians
from ..operators.missing import flag_missing
from ..operators.quantiles import quantile_summary
from ..operators.split import TEST, TRAIN, SplitRule, fit_split, with_row_hash
from ..sources import coerce_numeric, export_csv, export_parquet, staged
from .layout import Layout

LAYOUT = Layout()


def typed(df: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    return coerce_numeric(df, [c for c in layout.numeric if c in df.columns])


def service_rows(
    df: DataFrame, layout: Layout = LAYOUT, drop_null_target: bool = False
) -> DataFrame:
    """Rows of the wanted services, judged on the raw text (before trimming)."""
    target = layout.target if drop_null_target else None
    return clean.keep_categories(df, layout.service, layout.services, target)


def basket(
    bookings: DataFrame,
    layout: Layout = LAYOUT,
    columns: Iterable[str] | None = None,
    trim: bool = True,
    drop_null_target: bool = False,
) -> DataFrame:
    """One cleaned row per booking, with all columns or the asked ones."""
    rows = service_rows(typed(bookings, layout), layout, drop_null_target)
    wanted = list(columns) if columns is not None else rows.columns
    out = dedupe_first(rows, layout.key, layout.order_by).select(*wanted)
    if trim:
        out = clean.clean_categories(out, [c for c in layout.categorical if c in wanted])
    return out


def enriched(
    rows: DataFrame, layout: Layout = LAYOUT, night_fallback: bool = False
) -> DataFrame:
    """Adds the missing flag, time features, speed flag and clean distance.

    The missing flag looks at the distance as recorded, so it comes first.
    """
    out = flag_missing(rows, layout.analysis)
    out = clean.time_features(clean.parse_times(out, layout.time), layout.time, night_fallback)
    out = clean.flag_speed(out, layout.distance, layout.duration)
    return clean.clean_distance(out, layout.distance, layout.duration, layout.clean_distance)


def model_table(
    rows: DataFrame, layout: Layout = LAYOUT, night_fallback: bool = False
) -> DataFrame:
    """Key, 14 predictors and target of a ``basket``."""
    out = clean.time_features(clean.parse_times(rows, layout.time), layout.time, night_fallback)
    out = clean.clean_distance(out, layout.distance, layout.duration, layout.clean_distance)
    return out.select(*layout.model)


def split_table(
    model: DataFrame, layout: Layout = LAYOUT, seed: int | str = 123, stage: bool = True
) -> tuple[DataFrame, SplitRule]:
    """The model table with its ``dataset`` column, and the fitted rule.

    Several passes read the model table from here on, so it is written once, with the hash of its keys.
    """
    hash_col = "__row_hash" if stage else None
    table = staged(with_row_hash(model, layout.key, seed, hash_col)) if stage else model
    rule = fit_split(table, layout.key, layout.target, seed=seed, hash_col=hash_col)
    return rule.apply(table, hash_col=hash_col), rule


@dataclass(frozen=True)
class TrainFacts:
    """What is learned from training rows: fill values and the high-value threshold."""

    medians: dict[str, float | None]
    threshold: float | None


def train_facts(split: DataFrame, layout: Layout = LAYOUT, share: float = 0.8) -> TrainFacts:
    """Medians and threshold together, so that the training rows are passed over once.

    Their few numbers are written first: both passes of the quantiles would find the side again.
    """
    columns = [*layout.impute_numeric, layout.target]
    row = quantile_summary(
        staged(split.where(F.col("dataset") == TRAIN).select(*columns)),
        columns,
        [0.5, share],
        name=lambda c, p: f"median_{c}" if p == 0.5 else f"high_{c}",
    ).first()
    medians = {c: row[f"median_{c}"] for c in layout.impute_numeric}
    return TrainFacts(medians, row[f"high_{layout.target}"])


def imputed(
    split: DataFrame,
    layout: Layout = LAYOUT,
    levels: str = "union",
    facts: TrainFacts | None = None,
) -> DataFrame:
    """Training medians and ``Unknown`` on both sides; ``levels='train'`` also blanks
    categories that no training row has."""
    if facts is None:
        medians = train_medians(split, layout.impute_numeric).first().asDict()
    else:
        medians = facts.medians
    out = fill_unknown(fill_medians(split, medians), layout.impute_unknown)
    return restrict_levels(out, layout.impute_unknown) if levels == "train" else out


def write_datasets(
    filled: DataFrame, folder: str, fmt: str = "csv", side: str = "dataset"
) -> dict[str, tuple[DataFrame, str]]:
    """Writes the training, test and full tables; returns each with its path.

    ``filled`` should be a written table (``staged``): it is read three times.
    """
    write = {"csv": export_csv, "parquet": export_parquet}[fmt]
    parts = {
        "Train": filled.where(F.col(side) == TRAIN),
        "Test": filled.where(F.col(side) == TEST),
        "Full": filled,
    }
    out = {}
    for name, part in parts.items():
        path = f"{folder}/{name.lower()}_cleaned"
        write(part.drop(side), path)
        out[name] = (part.drop(side), path)
    return out


def prepare(bookings: DataFrame, folder: str, layout: Layout = LAYOUT, fmt: str = "csv") -> DataFrame:
    """From raw bookings to written train, test and full tables; returns the full one."""
    sided, _ = split_table(model_table(basket(bookings, layout), layout), layout)
    filled = staged(imputed(sided, layout, facts=train_facts(sided, layout)))
    write_datasets(filled, folder, fmt)
    return filled
