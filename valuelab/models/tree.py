"""Regression tree: rules, leaf segments and their sizes on both sides."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.split import TEST, TRAIN
from ..sources import staged
from .linear import distinct_levels, levels_table


@dataclass(frozen=True)
class TreeFit:
    encoder: PipelineModel
    tree: DecisionTreeRegressionModel
    predictors: tuple[str, ...]
    levels: dict[str, list[str]]

    def score(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Adds ``prediction`` and ``leaf``; null for rows that lack a number."""
        tree = self.tree.copy()
        tree.setPredictionCol(prediction)
        whole = F.lit(True)
        for p in self.predictors:
            if p not in self.levels:
                whole = whole & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
            else:
                whole = whole & F.col(p).isNotNull()
        whole = F.coalesce(whole, F.lit(False))
        scored = tree.transform(self.encoder.transform(df.where(whole)))
        scored = scored.select(*df.columns, prediction, "leaf")
        nothing = [F.lit(None).cast("double").alias(c) for c in (prediction, "leaf")]
        return scored.unionByName(df.where(~whole).select("*", *nothing))

    def importance(self, df: DataFrame) -> DataFrame:
        """``predictor``, ``importance`` (shares that add up to one), the largest first."""
        values = self.tree.featureImportances.toArray().tolist()
        rows = sorted(zip(self.predictors, values), key=lambda r: (-r[1], r[0]))
        return df.sparkSession.createDataFrame(rows, "predictor string, importance double")

    def rules(self) -> list[str]:
        """One readable rule per leaf, in leaf order (left to right)."""
        return leaf_rules(self.tree.toDebugString, self.predictors, self.levels)


@dataclass(frozen=True)
class Encoded:
    """Rows with their tree features, written once: growing a tree passes over them again and again."""

    rows: DataFrame
    encoder: PipelineModel
    levels: dict[str, list[str]]

    def where(self, condition: Column) -> Encoded:
        return Encoded(self.rows.where(condition), self.encoder, self.levels)


def encode(train: DataFrame, predictors: Sequence[str], kept: Sequence[str]) -> Encoded:
    """Categories numbered alphabetically, beside the columns ``kept``."""
    text = [p for p in predictors if isinstance(train.schema[p].dataType, T.StringType)]
    inputs = [f"__t_{p}" if p in text else p for p in predictors]
    outputs = [f"__t_{p}" for p in text]
    levels = distinct_levels(train, text)
    indexer = StringIndexer(
        inputCols=text, outputCols=outputs, stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    if text:
        indexer = indexer.fit(levels_table(train, levels))
    assembler = VectorAssembler(
        inputCols=inputs, outputCol="__tree_features", handleInvalid="skip"
    )
    encoder = Pipeline(stages=[indexer, assembler] if text else [assembler]).fit(train)
    rows = staged(encoder.transform(train).select("__tree_features", *kept))
    return Encoded(rows, encoder, levels)


def fit_tree(
    train: DataFrame,
    target: str,
    predictors: Sequence[str],
    max_depth: int = 4,
    min_rows: int = 50,
    seed: int = 123,
    bins: int = 32,
    encoded: Encoded | None = None,
) -> TreeFit:
    """Categories are indexed alphabetically and split as sets, numbers at thresholds: ``bins`` of
    them at most are tried, at quantiles of a number that has more values.

    ``encoded`` is ``train`` after :func:`encode`, if there is such a table already.
    """
    if encoded is None:
        encoded = encode(train, predictors, [target])
    most = max([len(v) + 1 for v in encoded.levels.values()], default=2)
    tree = DecisionTreeRegressor(
        featuresCol="__tree_features",
        labelCol=target,
        maxDepth=max_depth,
        minInstancesPerNode=min_rows,
        maxBins=max(bins, most),
        leafCol="leaf",
        seed=seed,
    ).fit(encoded.rows)
    return TreeFit(encoded.encoder, tree, tuple(predictors), encoded.levels)


_TEST = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")


def leaf_rules(text: str, predictors: Sequence[str], levels: dict[str, list[str]]) -> list[str]:
    """Rules from a printed tree, whose indentation gives the depth of each test."""
    path: list[tuple[int, str]] = []
    rules = []
    for line in text.splitlines()[1:]:
        found = _TEST.match(line)
        if not found:
            if "Predict:" in line:
                depth = len(line) - len(line.lstrip())
                rules.append(" and ".join(t for d, t in path if d < depth) or "all")
            continue
        indent, number, how, values = found.groups()
        name = predictors[int(number)]
        if values.startswith("{"):
            known = [*levels[name], "(other)"]
            values = "{" + ", ".join(known[int(float(v))] for v in values[1:-1].split(",")) + "}"
        path = [(d, t) for d, t in path if d < len(indent)]
        path.append((len(indent), f"{name} {how} {values}"))
    return rules


def tree_segments(fit: TreeFit, df: DataFrame, target: str, side: str = "dataset") -> DataFrame:
    """``leaf``, ``rule``, and n and mean of the target on each side, highest mean first."""
    per_leaf = (
        fit.score(df)
        .groupBy(F.col("leaf").cast("int").alias("leaf"))
        .agg(
            *[
                agg(F.when(F.col(side) == name, F.col(target))).alias(f"{label}_{name.lower()}")
                for name in (TRAIN, TEST)
                for agg, label in ((F.count, "n"), (F.avg, "mean"))
            ]
        )
    )
    rules = F.array(*[F.lit(r) for r in fit.rules()])
    return per_leaf.select("leaf", F.get(rules, F.col("leaf")).alias("rule"), *per_leaf.columns[1:]).orderBy(
        F.desc_nulls_last("mean_train"), "leaf"
    )
