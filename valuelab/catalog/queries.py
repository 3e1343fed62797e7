"""Named queries over the test tables: each one a few calls of library operators.

Ratios and averages are rounded so that engines which add in a different order
agree; the operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import plans, sources
from ..functions import parse_minute
from ..models import calibration, evaluate, linear, logistic, moments, pruning, tree
from ..operators import (
    celltypes,
    clean,
    dedupe,
    impute,
    missing,
    numbering,
    plotdata,
    profile,
    reshape,
    split,
    summarise,
)
from ..operators.quantiles import quantiles_long
from ..operators.split import TRAIN
from ..sources.bookings import COLUMNS as BOOKING_COLUMNS

L = plans.Layout()
EDA = [L.age, L.distance, L.duration, L.discount]
RAW = list(BOOKING_COLUMNS)
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded to ``digits``, or to what ``other`` says for a column."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), other.get(c, digits)) for c in doubles})


# Tables the queries start from.  Only the named columns are read and shuffled.


def _kept(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    wanted = list(columns) or RAW
    rows = plans.typed(sources.bookings(spark, sf, {*wanted, L.service}))
    return plans.service_rows(rows).select(*wanted)


def _basket(spark: SparkSession, sf: str, *columns: str, trim: bool = True) -> DataFrame:
    wanted = list(columns) or RAW
    needed = {*wanted, L.key, L.service, *L.order_by}
    return plans.basket(sources.bookings(spark, sf, needed), columns=wanted, trim=trim)


def _table(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The basket written once, for operators that pass over their input again."""
    return sources.staged(_basket(spark, sf, *columns))


def _with_flag(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    wanted = list(dict.fromkeys([*columns, *L.analysis]))
    return missing.flag_missing(_basket(spark, sf, *wanted), L.analysis)


def _model(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [c for c in L.model if c not in (L.clean_distance, "time_period", "is_weekend")]
    return plans.model_table(_basket(spark, sf, *wanted, L.time, L.distance))


def _sided(spark: SparkSession, sf: str) -> DataFrame:
    return plans.split_table(_model(spark, sf))[0]


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return plans.imputed(_sided(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    """The imputed table with its high-value label, and the label's threshold."""
    sided = _sided(spark, sf)
    facts = plans.train_facts(sided)
    rows = plans.imputed(sided, facts=facts)
    return evaluate.label_high_value(rows, L.target, facts.threshold), facts.threshold


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    """A fixed linear rule as the prediction, so that engines score alike."""
    rows, threshold = _labelled(spark, sf)
    rule = F.lit(20000.0) + F.lit(5000.0) * F.col(L.clean_distance) + F.lit(100.0) * F.col(L.age)
    return rows.withColumn("pred", rule), threshold


def _labelled_once(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled table written once, for fits that pass over it again."""
    return sources.staged(_labelled(spark, sf)[0])


def _modelling(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows on which every predictor is present."""
    return _labelled_once(spark, sf).dropna(subset=list(L.predictors))


def _fitting(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with label and predictors, written once."""
    rows, _ = _labelled(spark, sf)
    return sources.staged(rows.where(F.col("dataset") == TRAIN).select("high_value", *L.predictors))


def _line(spark: SparkSession, sf: str) -> tuple[DataFrame, moments.Moments]:
    """Complete training rows, and the cross products of the full linear model."""
    rows, _ = _labelled(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN).dropna(subset=list(L.predictors))
    train = sources.staged(train.select(L.key, L.target, *L.predictors))
    return train, moments.collect_moments(train, linear.fit_design(train, L.predictors), L.target)


# Sources and sinks


def export_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Writes train, test and full tables in both formats, reads them back, compares."""
    folder = sources.work_folder(spark)
    table = sources.staged(_filled(spark, sf).select(*L.model, "dataset"))
    results = []
    for fmt in ("csv", "parquet"):
        for name, (part, path) in plans.write_datasets(table, f"{folder}/{fmt}", fmt).items():
            # Parquet says what it holds; a CSV's header is compared with the schema it is read by.
            back = sources.load_table(spark, path, part.schema if fmt == "csv" else None, fmt)
            checked = sources.reconcile(part, back, L.target, sources.columns_of(spark, path, fmt))
            results.append(checked.select(F.lit(name).alias("dataset"), F.lit(fmt).alias("format"), "*"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return rounded(out, 2)


# Filters and shape


def invalid_distance_rows(spark: SparkSession, sf: str) -> DataFrame:
    shown = [L.key, L.service, L.distance, L.duration, "estimated_speed_kmh", L.target]
    rows = _basket(spark, sf, L.key, L.service, L.distance, L.duration, L.target)
    return rounded(
        clean.invalid_distance_rows(clean.flag_speed(rows, L.distance, L.duration), shown)
    )


# Missing values


def missing_labels(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_labels(
        missing.missing_profile(_basket(spark, sf, *L.analysis)), L.display_names
    )


def missing_mean_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(missing.mean_difference(_with_flag(spark, sf), "has_missing", L.target))


def missing_impact(spark: SparkSession, sf: str) -> DataFrame:
    others = [L.age, L.distance, L.duration, L.discount]
    rows = sources.staged(_with_flag(spark, sf).select("has_missing", L.target, *others))
    return rounded(missing.compare_groups(rows, "has_missing", L.target, others))


def missing_target_compare(spark: SparkSession, sf: str) -> DataFrame:
    stats = ("n_rows", "mean", "median", "sd", "min", "max")
    rows = sources.staged(_with_flag(spark, sf).select("has_missing", L.target))
    return rounded(summarise.summarise(rows, L.target, ["has_missing"], stats))


def cat_missing_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_flag(spark, sf)
    return rounded(missing.category_shares_by(rows, "has_missing", L.categorical))


def cat_missing_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(missing.category_gap(_with_flag(spark, sf), "has_missing", L.categorical))


# Cleaning


def parse_datetime(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources.bookings(spark, sf, [L.key, "ord_a", L.target, L.time])
    return rows.withColumn(L.time, parse_minute(F.col(L.time)))


def time_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.parse_times(_basket(spark, sf, L.key, L.time), L.time)
    return clean.time_features(rows, L.time)


def time_period_night(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.parse_times(_basket(spark, sf, L.key, L.time), L.time)
    return clean.time_features(rows, L.time, night_fallback=True).select(L.key, "time_period")


def _distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _basket(spark, sf, L.key, L.distance, L.duration)
    return clean.clean_distance(
        clean.flag_speed(rows, L.distance, L.duration), L.distance, L.duration
    )


def speed_flag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_distance(spark, sf).select(L.key, "estimated_speed_kmh", "distance_invalid"))


def factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.parse_times(_basket(spark, sf, L.time, *L.categorical), L.time)
    rows = clean.time_features(rows, L.time)
    return reshape.factor_levels(rows, [*L.categorical, "time_period", "is_weekend"])


# Summaries


def _value_by(column: str, stats: tuple[str, ...] = summarise.EIGHT, by_mean: bool = False) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = summarise.summarise(_table(spark, sf, column, L.target), L.target, [column], stats)
        return rounded(summarise.by_mean(out, column) if by_mean else out)

    return query


FOUR = ("n_rows", "mean", "median", "sd")
value_by_service = _value_by(L.service)


def correlations(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {
        "age_correlation": L.age,
        "distance_correlation": L.distance,
        "duration_correlation": L.duration,
        "discount_correlation": L.discount,
    }
    return rounded(summarise.correlations(_basket(spark, sf, *EDA, L.target), pairs, L.target))


def impute_mean_compare(spark: SparkSession, sf: str) -> DataFrame:
    sided = _sided(spark, sf)
    return rounded(
        impute.compare_means(sided, plans.imputed(sided), L.impute_numeric, L.imputed_names)
    )


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    sided, rule = plans.split_table(_model(spark, sf))
    return sided.select(L.key, rule.bin().alias("bin"), "dataset")


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    table = sources.staged(_model(spark, sf).select(L.key, L.target))
    sided, rule = plans.split_table(table, stage=False)
    n_rows = sum(n for n, _ in rule.sizes.values()) + rule.n_without_target
    sizes = split.split_sizes(sided)
    total = table.count()
    return rounded(sizes.withColumn("rows_conserved", F.lit(n_rows == total)), 2)


def stack_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _filled(spark, sf)
    parts = {
        name: rows.where(F.col("dataset") == name).drop("dataset") for name in ("Train", "Test")
    }
    return reshape.stack(parts)


def level_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = _filled(spark, sf)
    return reshape.union_levels(
        rows.where(F.col("dataset") == "Train"),
        rows.where(F.col("dataset") == "Test"),
        L.impute_unknown,
    )


# Figures


def _boxes(*by: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(plotdata.box_plot(_table(spark, sf, *by, L.target), L.target, by))

    return query


def _paired_boxes(by: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(plotdata.box_plot_pairs(_table(spark, sf, by, L.target), L.target, [by]))

    return query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return sources.load_table(spark, f"{sf}/events.parquet")


def events_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("event_id", "event_type", "value")
    boxes = plotdata.box_plot(rows, "value", ["event_type"])
    return plotdata.outliers(rows, "value", boxes, ["event_type"])


def lm_fit(spark: SparkSession, sf: str) -> DataFrame:
    fit = plotdata.line_fit(_basket(spark, sf, L.discount, L.target), L.discount, L.target)
    out = fit.withColumn("x_variance", F.col("sxx") / F.col("n")).drop("sxx")
    return rounded(out, intercept=4, r2=9, residual_se=4, x_variance=2)


def lm_band(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plotdata.line_band(_table(spark, sf, L.discount, L.target), L.discount, L.target), 4)


# Models and evaluation


def high_value_label(spark: SparkSession, sf: str) -> DataFrame:
    rows, threshold = _scored(spark, sf)
    return rounded(
        rows.select(L.key, "dataset", "high_value", F.lit(threshold).alias("threshold"))
    )


def mlr_nested(spark: SparkSession, sf: str) -> DataFrame:
    return linear.nested_regressions(_modelling(spark, sf), L.target, L.nested_predictors)


TWO = ((L.clean_distance,), (L.duration,))


def mlr_two(spark: SparkSession, sf: str) -> DataFrame:
    """Nested steps on one, then two numbers; the chance of the F value is left to the tests."""
    steps = linear.nested_regressions(_filled(spark, sf), L.target, TWO)
    return rounded(steps.drop("p_value"), r2_train=9, r2_test=9, adj_r2_train=9, adj_r2_test=9, adj_r2_gain=9, rmse_train=4, rmse_test=4, mae_train=4, mae_test=4, rmse_test_gain=4, f_value=4)


def _train_moments(spark: SparkSession, sf: str, *predictors: str) -> tuple[DataFrame, moments.Moments]:
    train = sources.staged(_filled(spark, sf).where(F.col("dataset") == TRAIN).select(L.target, *predictors))
    return train, moments.collect_moments(train, linear.fit_design(train, predictors), L.target)


def mlr_robust(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of the full model with usual and sandwich errors."""
    return moments.robust_coefficients(*_train_moments(spark, sf, *L.predictors))


def mlr_robust_one(spark: SparkSession, sf: str) -> DataFrame:
    told = moments.robust_coefficients(*_train_moments(spark, sf, L.clean_distance))
    return rounded(told.drop("robust_p"), 4)


def reset_test(spark: SparkSession, sf: str) -> DataFrame:
    """Linearity of the full model: squares and cubes of the fitted value."""
    return moments.reset_test(*_train_moments(spark, sf, *L.predictors))


def reset_one(spark: SparkSession, sf: str) -> DataFrame:
    told = moments.reset_test(*_train_moments(spark, sf, L.clean_distance), powers=(2,))
    return rounded(told.drop("p_value"), 4)


def collinearity(spark: SparkSession, sf: str) -> DataFrame:
    """Near dependences of the full model's columns, and the terms that take part."""
    return moments.collinearity(*_train_moments(spark, sf, *L.predictors))


def collinearity_pair(spark: SparkSession, sf: str) -> DataFrame:
    told = moments.collinearity(*_train_moments(spark, sf, L.clean_distance, L.duration), centred=True)
    return rounded(told)


def mlr_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    rows = _modelling(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN)
    design = linear.fit_design(train, L.predictors)
    encoded = sources.staged(design.apply(train).select(L.target, "features"))
    return linear.coefficients(rows, linear.fit_line(encoded, L.target), design.names)


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _scored(spark, sf)
    out = evaluate.regression_metrics(rows, L.target, {"rule": ("pred", 2)}, ["dataset"])
    return rounded(out.drop("model"))


def residual_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _scored(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN)
    return rounded(evaluate.residual_bins(train, L.target, "pred"))


def breusch_pagan(spark: SparkSession, sf: str) -> DataFrame:
    return moments.breusch_pagan(*_line(spark, sf))


def vif(spark: SparkSession, sf: str) -> DataFrame:
    return moments.inflation_factors(*_line(spark, sf))


def cooks_distance(spark: SparkSession, sf: str) -> DataFrame:
    return moments.cooks_distance(*_line(spark, sf), L.key)


# The same operators where SQL has a closed form: one factor, or one or two numbers.


def _train_line(spark: SparkSession, sf: str, *predictors: str) -> tuple[DataFrame, linear.Design]:
    train = _filled(spark, sf).where(F.col("dataset") == TRAIN)
    design = linear.fit_design(train, predictors)
    encoded = sources.staged(design.apply(train).select(L.key, L.target, "features"))
    return linear.fit_line(encoded, L.target).transform(encoded), design


def vif_pair(spark: SparkSession, sf: str) -> DataFrame:
    encoded, design = _train_line(spark, sf, L.clean_distance, L.duration)
    return rounded(linear.inflation_factors(encoded, design.names))


def breusch_pagan_one(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = _train_line(spark, sf, L.clean_distance)
    return rounded(linear.breusch_pagan(scored, L.target).drop("p_value"), 4)


def cooks_distance_one(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = _train_line(spark, sf, L.clean_distance)
    return rounded(linear.cooks_distance(scored, L.key, L.target), 9, residual=3)


def odds_ratios_one(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _labelled(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN)
    fit = logistic.fit_logit(train, "high_value", [L.service])
    return rounded(logistic.odds_ratios(fit.coefficients(rows)).select("term", "odds_ratio"), 4)


def logit_scores_one(spark: SparkSession, sf: str) -> DataFrame:
    """Every test row's probability from the one-factor model: its service's share."""
    rows, _ = _labelled(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN)
    fit = logistic.fit_logit(train, "high_value", [L.service])
    scored = fit.score(rows.where(F.col("dataset") != TRAIN))
    return rounded(evaluate.score_ranking(scored, L.key, "probability", "high_value"), 5)


def firth_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Bias-reduced coefficients of the full logistic model."""
    train = _fitting(spark, sf)
    return logistic.fit_firth(train, "high_value", L.predictors).coefficients(train)


def firth_odds_one(spark: SparkSession, sf: str) -> DataFrame:
    """One factor: half a row is added to either class of each level."""
    rows, _ = _labelled(spark, sf)
    fit = logistic.fit_firth(rows.where(F.col("dataset") == TRAIN), "high_value", [L.service])
    return rounded(logistic.odds_ratios(fit.coefficients(rows)).select("term", "odds_ratio"))


def residual_normal_points(spark: SparkSession, sf: str) -> DataFrame:
    """Q-Q points of the fixed rule's residuals on the training rows."""
    rows, _ = _scored(spark, sf)
    residual = (F.col(L.target) - F.col("pred")).alias("residual")
    table = sources.staged(rows.where(F.col("dataset") == TRAIN).select(residual))
    return rounded(evaluate.normal_points(table, "residual"), 6)


def auc_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _scored(spark, sf)
    return rounded(evaluate.auc_interval(rows.where(F.col("dataset") != TRAIN), "high_value", "pred"))


def calibrated_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows by the chance of a high value that training rows with such a score have.

    The score is the fixed rule in steps of 1,000.
    """
    rows, _ = _scored(spark, sf)
    step = F.floor(F.col("pred") / 1000).cast("double")
    table = sources.staged(rows.select(L.key, "dataset", "high_value", step.alias("score")))
    blocks = calibration.isotonic_blocks(table.where(F.col("dataset") == TRAIN), "high_value", "score")
    scored = calibration.calibrate(table.where(F.col("dataset") != TRAIN), blocks, "score")
    return rounded(evaluate.score_ranking(scored, L.key, "probability", "high_value"))


def row_number(spark: SparkSession, sf: str) -> DataFrame:
    """Number of every booking in the order in which its duplicates are ranked."""
    rows = _basket(spark, sf, L.key, *L.order_by)
    return numbering.row_numbers(rows, [*L.order_by, L.key]).select(L.key, "row_number")


def guess_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the raw text columns, if one cell in ten may be of another."""
    return celltypes.guess_types(sources.bookings(spark, sf), least_share=0.9)


def rejected_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that the numeric and the time column cannot hold."""
    rows = sources.bookings(spark, sf, [L.key, L.discount, L.time, L.payment])
    return celltypes.rejected_cells(rows, [L.key], {L.discount: "number", L.time: "timestamp", L.payment: "boolean"})


def tree_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """Size, cost and cross-validated error of each subtree of a deep tree."""
    rows, _ = _labelled(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN).dropna(subset=list(L.predictors))
    train = sources.staged(train.select(L.key, L.target, *L.predictors))
    return pruning.validated_tree(train, L.target, L.predictors, L.key, max_depth=6).table(train)


def same_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the training and test tables have the same columns, and how many."""
    rows = _filled(spark, sf)
    train, test = (rows.where(F.col("dataset") == side) for side in (TRAIN, "Test"))
    same = split.same_columns(train, test)
    counts = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("dataset", "n_rows", F.lit(len(train.columns)).alias("n_columns"), F.lit(same).alias("same"))


def tree_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of the tree fitted on complete rows; rows that reach no leaf have a line of their own."""
    rows = _labelled_once(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN).dropna(subset=list(L.predictors))
    fit = tree.fit_tree(train, L.target, L.predictors)
    return tree.tree_segments(fit, rows, L.target)


def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the variance reduction that each predictor brings."""
    rows = _modelling(spark, sf)
    return tree.fit_tree(rows.where(F.col("dataset") == TRAIN), L.target, L.predictors).importance(rows)


def model_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Best linear step against the tree, on test rows."""
    rows = _modelling(spark, sf)
    fits = linear.nested_fits(rows, L.target, L.nested_predictors)
    line = fits[linear.choose_step(linear.nested_steps(rows, L.target, fits)) - 1]
    fit = tree.fit_tree(rows.where(F.col("dataset") == TRAIN), L.target, L.predictors)
    test = moments.predictions(rows.where(F.col("dataset") != TRAIN), {"__line": line}, [L.target, *L.predictors])
    scored = fit.score(sources.staged(test), "__tree")
    models = {
        "Best linear model": ("__line", len(line.used)),
        "Regression tree": ("__tree", len(L.predictors)),
    }
    return evaluate.regression_metrics(scored, L.target, models).drop("adj_r2")


def _logit(spark: SparkSession, sf: str) -> tuple[logistic.LogitFit, DataFrame]:
    """The model fitted on complete training rows, and all labelled rows."""
    rows = _labelled_once(spark, sf)
    train = rows.where(F.col("dataset") == TRAIN).dropna(subset=list(L.predictors))
    return logistic.fit_logit(train, "high_value", L.predictors), rows


def logit_fit(spark: SparkSession, sf: str) -> DataFrame:
    train = _fitting(spark, sf).dropna(subset=list(L.predictors))
    return logistic.fit_logit(train, "high_value", L.predictors).coefficients(train)


def odds_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return logistic.odds_ratios(logit_fit(spark, sf))


def logit_ranking(spark: SparkSession, sf: str) -> DataFrame:
    fit, rows = _logit(spark, sf)
    scored = fit.score(rows.where(F.col("dataset") != TRAIN))
    return evaluate.score_ranking(scored, L.key, "probability", "high_value")


def logit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts, ratios and AUC of the logistic model on test rows, scored once."""
    fit, rows = _logit(spark, sf)
    test = fit.score(rows.where(F.col("dataset") != TRAIN))
    scored = sources.staged(test.select(L.key, "high_value", "probability"))
    auc = evaluate.roc_auc(scored, "high_value", "probability").first()["auc"]
    out = evaluate.classification_metrics(scored, "high_value", "probability")
    counts = scored.agg(F.count("probability"), F.count(F.lit(1))).first()
    return out.withColumns(
        {
            "auc": F.lit(auc).cast("double"),
            "n_scored": F.lit(counts[0]).cast("bigint"),
            "n_unscored": F.lit(counts[1] - counts[0]).cast("bigint"),
        }
    )


def score_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _scored(spark, sf)
    test = rows.where(F.col("dataset") != TRAIN).withColumnRenamed("pred", "score")
    return rounded(evaluate.score_ranking(test, L.key, "score", "high_value"))


def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _scored(spark, sf)
    return rounded(
        evaluate.classification_metrics(rows, "high_value", "pred", 60000.0, ["dataset"])
    )


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _scored(spark, sf)
    return rounded(evaluate.roc_auc(rows.where(F.col("dataset") != TRAIN), "high_value", "pred"))


def queries() -> dict[str, Query]:
    cat, ana = L.categorical, L.analysis
    return {
        # Sources and sinks
        "load_bookings": lambda s, d: sources.bookings(s, d),
        "coerce_numeric": lambda s, d: plans.typed(sources.bookings(s, d)),
        "export_reconcile": export_reconcile,
        # Filters and shape
        "filter_service": lambda s, d: _kept(s, d),
        "filter_service_valid": lambda s, d: plans.service_rows(
            plans.typed(sources.bookings(s, d)), drop_null_target=True
        ),
        "invalid_distance_rows": invalid_distance_rows,
        "complete_pairs": lambda s, d: clean.complete_pairs(
            _basket(s, d, L.discount, L.target), L.discount, L.target
        ),
        "model_table": _model,
        "table_shape": lambda s, d: profile.table_shape(_model(s, d)),
        "schema_profile": lambda s, d: profile.schema_profile(_model(s, d)),
        # Duplicates
        "dup_summary": lambda s, d: dedupe.duplicate_summary(_kept(s, d, L.key), L.key),
        "dup_rows": lambda s, d: dedupe.duplicate_rows(_kept(s, d), L.key, L.order_by),
        "dedupe_first": lambda s, d: _basket(s, d, trim=False),
        # Missing values and quality
        "missing_summary": lambda s, d: rounded(missing.missing_profile(_kept(s, d, *RAW[:16]))),
        "missing_counts": lambda s, d: rounded(missing.missing_profile(_basket(s, d, *ana))),
        "model_missing": lambda s, d: rounded(
            missing.missing_profile(_model(s, d), L.model[1:])
        ),
        "predictor_missing": lambda s, d: rounded(
            missing.missing_profile(_basket(s, d, *L.raw_predictors))
        ),
        "missing_after_impute": lambda s, d: rounded(
            missing.missing_profile(_filled(s, d), L.model[1:], ["dataset"])
        ),
        "missing_map": lambda s, d: missing.missing_map(_basket(s, d, L.key, *ana), L.key, ana),
        "missing_map_grid": lambda s, d: missing.missing_map_grid(
            _basket(s, d, L.key, *ana), L.key, ana
        ),
        "missing_labels": missing_labels,
        "has_missing": lambda s, d: _with_flag(s, d, L.key).select(L.key, "has_missing"),
        "missing_group_summary": lambda s, d: rounded(
            missing.group_sizes(_with_flag(s, d), "has_missing")
        ),
        "missing_impact": missing_impact,
        "missing_target_compare": missing_target_compare,
        "missing_mean_diff": missing_mean_diff,
        "cat_missing_share": cat_missing_share,
        "cat_missing_diff": cat_missing_diff,
        "category_values": lambda s, d: profile.category_values(_basket(s, d, *cat, trim=False), cat),
        "category_values_trimmed": lambda s, d: profile.category_values(
            _basket(s, d, *cat, trim=False), cat, trimmed=True
        ),
        "category_values_clean": lambda s, d: profile.category_values(
            _basket(s, d, *cat), cat, keep_null=False
        ),
        "category_counts": lambda s, d: profile.category_counts(_basket(s, d, L.promo), L.promo),
        "category_counts_sorted": lambda s, d: profile.all_category_counts(
            _basket(s, d, *cat), cat
        ),
        "promo_discount_crosstab": lambda s, d: profile.missing_crosstab(
            _basket(s, d, L.promo, L.discount), L.promo, L.discount
        ),
        "whitespace_values": lambda s, d: profile.padded_values(
            _basket(s, d, *cat, trim=False), cat
        ),
        "empty_values": lambda s, d: profile.empty_values(
            _basket(s, d, *cat, trim=False), cat
        ),
        "impossible_values": lambda s, d: profile.impossible_values(
            _basket(s, d, L.age, L.distance, L.duration, L.target),
            L.age,
            L.distance,
            L.duration,
            L.target,
        ),
        # Cleaning
        "clean_categories": lambda s, d: _basket(s, d, L.key, *cat),
        "parse_datetime": parse_datetime,
        "time_features": time_features,
        "time_period_night": time_period_night,
        "speed_flag": speed_flag,
        "distance_clean": lambda s, d: _distance(s, d).select(
            L.key, L.distance, L.clean_distance
        ),
        "distance_clean_effect": lambda s, d: clean.cleaning_effect(_distance(s, d), L.distance),
        "factor_levels": factor_levels,
        # Summaries
        "target_summary": lambda s, d: rounded(
            summarise.summarise(_table(s, d, L.target), L.target)
        ),
        "value_by_service": value_by_service,
        "value_by_promo": _value_by(L.promo, by_mean=True),
        "discount_summary": lambda s, d: rounded(
            summarise.summarise(
                _table(s, d, L.discount), L.discount, stats=(*summarise.EIGHT, "missing")
            )
        ),
        "value_by_traffic": _value_by(L.traffic, FOUR, by_mean=True),
        "value_by_weather": _value_by(L.weather, FOUR, by_mean=True),
        "numeric_summary": lambda s, d: rounded(
            summarise.summarise_many(_table(s, d, *EDA), EDA)
        ),
        "category_share": lambda s, d: rounded(
            summarise.category_shares(_basket(s, d, *cat), cat)
        ),
        "value_by_category": lambda s, d: rounded(
            summarise.value_by_category(_table(s, d, *cat, L.target), cat, L.target)
        ),
        "correlations": correlations,
        "six_number": lambda s, d: rounded(
            summarise.summarise(
                sources.staged(_distance(s, d).select(L.clean_distance)),
                L.clean_distance,
                stats=("min", "q1", "median", "mean", "q3", "max", "missing"),
            )
        ),
        "skewness_type3": lambda s, d: rounded(
            summarise.skewness(_basket(s, d, L.target), L.target)
        ),
        "events_skewness": lambda s, d: rounded(summarise.skewness(_events(s, d), "value")),
        "quantiles": lambda s, d: rounded(
            quantiles_long(_table(s, d, L.target), L.target, [0.25, 0.75, 0.8])
        ),
        "iqr_fence": lambda s, d: rounded(
            summarise.iqr_fences(_table(s, d, L.target), L.target)
        ),
        "events_iqr_fence": lambda s, d: rounded(summarise.iqr_fences(_events(s, d), "value")),
        "split_category_share": lambda s, d: rounded(
            summarise.proportions_by(
                _filled(s, d),
                "dataset",
                ["Train", "Test"],
                [L.service, L.segment, L.city, L.payment, L.channel],
            )
        ),
        "impute_mean_compare": impute_mean_compare,
        # Reshape
        "segment_order": lambda s, d: rounded(
            reshape.levels_by_median(_table(s, d, L.segment, L.target), L.segment, L.target)
        ),
        "stack_split": stack_split,
        "level_union": level_union,
        "unpivot_categories": lambda s, d: reshape.melt_categories(
            _basket(s, d, L.key, *cat, L.target), cat, [L.key, L.target]
        ),
        # Split and imputation
        "stratified_split": stratified_split,
        "split_sizes": split_sizes,
        "split_target_summary": lambda s, d: rounded(
            summarise.summarise(_sided(s, d), L.target, ["dataset"])
        ),
        "split_numeric_summary": lambda s, d: rounded(
            summarise.summarise_many(
                _filled(s, d),
                [L.age, L.clean_distance, L.duration, L.discount],
                ["dataset"],
                ("mean", "median", "sd"),
            )
        ),
        "impute_median": lambda s, d: _filled(s, d).select(
            L.key, "dataset", *L.impute_numeric
        ),
        "impute_unknown": lambda s, d: _filled(s, d).select(
            L.key, "dataset", *L.impute_unknown
        ),
        "restrict_levels": lambda s, d: impute.restrict_levels(
            _sided(s, d), [L.promo, L.city]
        ).select(L.key, "dataset", L.promo, L.city),
        "train_medians": lambda s, d: rounded(
            impute.train_medians(_sided(s, d), L.impute_numeric)
        ),
        "final_cleaned": _filled,
        # Figures
        "histogram30": lambda s, d: rounded(
            plotdata.histogram(_table(s, d, L.target), L.target)
        ),
        "histogram_high_value": lambda s, d: rounded(
            plotdata.histogram_split(_table(s, d, L.target), L.target)
        ),
        "boxplot_service": _boxes(L.service),
        "boxplot_segment": _boxes(L.segment),
        "boxplot_segment_service": _boxes(L.service, L.segment),
        "boxplot_traffic": _paired_boxes(L.traffic),
        "boxplot_weather": _paired_boxes(L.weather),
        "boxplot_split": lambda s, d: rounded(
            plotdata.box_plot(_sided(s, d), L.target, ["dataset"])
        ),
        "events_boxplot": lambda s, d: rounded(
            plotdata.box_plot(_events(s, d), "value", ["event_type"])
        ),
        "events_outliers": events_outliers,
        "density2d": lambda s, d: plotdata.density_2d(
            _table(s, d, L.discount, L.target), L.discount, L.target
        ),
        "lm_fit": lm_fit,
        "lm_band": lm_band,
        # Models and evaluation
        "high_value_label": high_value_label,
        "mlr_nested": mlr_nested,
        "mlr_coefficients": mlr_coefficients,
        "mlr_two": mlr_two,
        "mlr_robust": mlr_robust,
        "mlr_robust_one": mlr_robust_one,
        "reset_test": reset_test,
        "reset_one": reset_one,
        "collinearity": collinearity,
        "collinearity_pair": collinearity_pair,
        "regression_metrics": regression_metrics,
        "residual_bins": residual_bins,
        "breusch_pagan": breusch_pagan,
        "vif": vif,
        "cooks_distance": cooks_distance,
        "tree_segments": tree_segments,
        "vif_pair": vif_pair,
        "breusch_pagan_one": breusch_pagan_one,
        "cooks_distance_one": cooks_distance_one,
        "odds_ratios_one": odds_ratios_one,
        "logit_scores_one": logit_scores_one,
        "same_columns": same_columns,
        "final_train_levels": lambda s, d: plans.imputed(_sided(s, d), levels="train").select(
            L.key, "dataset", L.promo
        ),
        "tree_importance": tree_importance,
        "tree_pruning": tree_pruning,
        "firth_fit": firth_fit,
        "firth_odds_one": firth_odds_one,
        "residual_normal_points": residual_normal_points,
        "auc_interval": auc_interval,
        "row_number": row_number,
        "calibrated_ranking": calibrated_ranking,
        "guess_types": guess_types,
        "rejected_cells": rejected_cells,
        "model_compare": model_compare,
        "logit_fit": logit_fit,
        "odds_ratios": odds_ratios,
        "logit_ranking": logit_ranking,
        "logit_metrics": logit_metrics,
        "score_ranking": score_ranking,
        "classification_metrics": classification_metrics,
        "roc_auc": roc_auc,
    }
