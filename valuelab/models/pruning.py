"""Weakest-link pruning of a regression tree, with cross-validated errors of all its subtrees.

A tree is grown once and never searched again: every row is routed to its leaf, and the count,
sum and sum of squares of each leaf say all about every subtree, since a node's rows are those of
its leaves.  So one combining pass per fitted tree gives the errors of all its prunings, on the
rows it was grown on and on those it has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import Encoded, TreeFit, encode, fit_tree


@dataclass(frozen=True)
class Shape:
    """Nodes of a binary tree in the order in which they are met from the left, root first."""

    #: left and right child of each node, -1 at a leaf
    children: tuple[tuple[int, int], ...]
    #: first and last-but-one number of the leaves under each node
    leaves: tuple[tuple[int, int], ...]

    @property
    def n_leaves(self) -> int:
        return self.leaves[0][1]


def shape_of(text: str) -> Shape:
    """The shape of a printed tree: a test, its left branch, ``Else``, its right branch; or a leaf."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]
    children: list[tuple[int, int]] = []
    leaves: list[tuple[int, int]] = []
    at = 0

    def read(first_leaf: int) -> int:
        nonlocal at
        node = len(children)
        children.append((-1, -1))
        leaves.append((first_leaf, first_leaf + 1))
        line = lines[at]
        at += 1
        if line.startswith("If "):
            left = read(first_leaf)
            at += 1  # the matching Else
            right = read(leaves[left][1])
            children[node] = (left, right)
            leaves[node] = (first_leaf, leaves[right][1])
        return node

    read(0)
    return Shape(tuple(children), tuple(leaves))


@dataclass(frozen=True)
class Pruning:
    """One subtree of the weakest-link sequence."""

    alpha: float
    n_leaves: int
    #: sum of squared errors on the rows of ``stats``
    sse: float
    #: the node whose mean each grown leaf predicts
    stands_for: tuple[int, ...]


def node_sums(shape: Shape, stats: np.ndarray) -> np.ndarray:
    """Count, sum and sum of squares of each node, from those of the leaves."""
    upto = np.vstack([np.zeros((1, 3)), np.cumsum(stats, axis=0)])
    low, high = np.array(shape.leaves).T
    return upto[high] - upto[low]


def _spread(sums: np.ndarray) -> np.ndarray:
    """Sum of squares about the mean of each node."""
    n, s, q = sums.T
    return np.maximum(q - s * s / np.where(n > 0, n, 1), 0.0)


def weakest_links(shape: Shape, stats: np.ndarray) -> list[Pruning]:
    """The sequence of smallest subtrees that are best at some price per leaf, the grown tree first.

    Each step cuts below the node whose branch saves the least error per leaf; ties go together.
    """
    sums = node_sums(shape, stats)
    cost = _spread(sums)
    nodes = len(shape.children)
    cut = [a < 0 for a, _ in shape.children]
    parent = [-1] * nodes
    for node, (a, b) in enumerate(shape.children):
        if a >= 0:
            parent[a] = parent[b] = node

    def below() -> tuple[list[float], list[int]]:
        held, size = [0.0] * nodes, [0] * nodes
        for node in reversed(range(nodes)):  # children come after their parent
            if cut[node]:
                held[node], size[node] = float(cost[node]), 1
            else:
                a, b = shape.children[node]
                held[node], size[node] = held[a] + held[b], size[a] + size[b]
        return held, size

    def snapshot(alpha: float, held: list[float], size: list[int]) -> Pruning:
        stands = [0] * shape.n_leaves
        todo = [0]
        while todo:
            node = todo.pop()
            if cut[node]:
                low, high = shape.leaves[node]
                stands[low:high] = [node] * (high - low)
            else:
                todo += shape.children[node]
        return Pruning(alpha, size[0], held[0], tuple(stands))

    def open_nodes() -> list[int]:
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if not cut[node]:
                out.append(node)
                todo += shape.children[node]
        return out

    held, size = below()
    scale = float(cost[0]) or 1.0
    out = []
    alpha = 0.0
    while True:
        gain = {t: (float(cost[t]) - held[t]) / (size[t] - 1) for t in open_nodes()}
        if not gain or min(gain.values()) > alpha + 1e-12 * scale:
            out.append(snapshot(alpha, held, size))
            if not gain:
                return out
            alpha = min(gain.values())
        for t, g in gain.items():
            if g <= alpha + 1e-12 * scale:
                cut[t] = True
        held, size = below()


def held_out_error(shape: Shape, grown: np.ndarray, unseen: np.ndarray, pruning: Pruning) -> float:
    """Squared error on ``unseen`` leaf sums of a subtree whose means come from ``grown`` ones."""
    sums = node_sums(shape, grown)
    mean = sums[:, 1] / np.where(sums[:, 0] > 0, sums[:, 0], 1)
    c = mean[list(pruning.stands_for)]
    n, s, q = unseen.T
    return float(np.maximum(q - 2 * c * s + n * c * c, 0.0).sum())


def leaf_sums(scored: DataFrame, target: str, n_leaves: int, middle: float, side: str | None = None):
    """Count, sum and sum of squares of ``target`` minus ``middle`` per leaf: one combining pass.

    With ``side``, a true or false column, two tables: of its false rows and of its true ones.
    """
    y = F.col(target).cast("double") - F.lit(middle)
    which = F.col(side) if side is not None else F.lit(False)
    sums = (
        scored.where(F.col("leaf").isNotNull() & y.isNotNull())
        .groupBy(which.alias("side"), F.col("leaf").cast("int").alias("leaf"))
        .agg(F.count(F.lit(1)), F.sum(y), F.sum(y * y))
    )
    out = np.zeros((2, n_leaves, 3))
    for row in sums.collect():  # leaves of one tree
        out[int(row[0]), row[1]] = row[2:]
    return (out[0], out[1]) if side is not None else out[0]


@dataclass(frozen=True)
class PrunedTree:
    """A grown tree, its weakest-link sequence and, if validated, the errors of each subtree."""

    grown: TreeFit
    shape: Shape
    sums: np.ndarray
    middle: float
    sequence: tuple[Pruning, ...]
    cv_error: tuple[float, ...] = ()
    cv_se: tuple[float, ...] = ()
    chosen: int = 0

    def table(self, df: DataFrame) -> DataFrame:
        """``step``, ``n_leaves``, ``alpha``, ``train_error``, ``cv_error``, ``cv_se``, ``chosen``.

        Errors are mean squares; alpha is the price of a leaf, in the same unit, from which on
        the step's subtree is best.
        """
        n = max(1.0, float(self.sums[:, 0].sum()))
        cv = self.cv_error or (None,) * len(self.sequence)
        se = self.cv_se or (None,) * len(self.sequence)
        rows = [
            (i + 1, p.n_leaves, p.alpha / n, p.sse / n, cv[i], se[i], i == self.chosen)
            for i, p in enumerate(self.sequence)
        ]
        return df.sparkSession.createDataFrame(
            rows,
            "step int, n_leaves int, alpha double, train_error double, cv_error double, cv_se double, chosen boolean",
        )

    def score(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Adds ``prediction`` and ``leaf`` of the chosen subtree; null for rows that lack a number.

        ``leaf`` is the number of the node the row ends in.
        """
        stands = self.sequence[self.chosen].stands_for
        sums = node_sums(self.shape, self.sums)
        mean = sums[:, 1] / np.where(sums[:, 0] > 0, sums[:, 0], 1) + self.middle
        scored = self.grown.score(df, prediction)
        leaf = F.col("leaf").cast("int")
        means = F.lit([float(mean[t]) for t in stands])
        return scored.withColumns(
            {prediction: F.get(means, leaf), "leaf": F.get(F.lit([float(t) for t in stands]), leaf)}
        )


def grow(
    train: DataFrame, target: str, predictors: Sequence[str], middle: float, encoded: Encoded | None = None, **options
) -> PrunedTree:
    """A tree on ``train`` and its weakest-link sequence, unvalidated; the grown tree is chosen.

    ``encoded`` is ``train`` after :func:`tree.encode`, if there is such a table already.
    """
    fit = fit_tree(train, target, predictors, encoded=encoded, **options)
    shape = shape_of(fit.tree.toDebugString)
    routed = fit.score(train) if encoded is None else fit.tree.transform(encoded.rows)
    sums = leaf_sums(routed, target, shape.n_leaves, middle)
    return PrunedTree(fit, shape, sums, middle, tuple(weakest_links(shape, sums)))


def folds_without(rows: DataFrame, levels: dict[str, list[str]], fold: str) -> set[int]:
    """The folds outside of which some level does not occur: one combining pass."""
    text = list(levels)
    if not text:
        return set()
    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(p).alias("level")) for i, p in enumerate(text)])
    found = rows.select(F.col(fold), F.inline(cells)).where(F.col("level").isNotNull()).groupBy("at", "level")
    alone = found.agg(F.min(fold).alias("low"), F.max(fold).alias("high")).where("low = high")
    return {int(r[0]) for r in alone.select("low").distinct().collect()}


def validated_tree(
    train: DataFrame,
    target: str,
    predictors: Sequence[str],
    key: str,
    folds: int = 5,
    one_se: bool = True,
    seed: int = 123,
    **options,
) -> PrunedTree:
    """A tree whose size is chosen by ``folds``-fold cross-validation.

    ``train`` is read several times: stage it.  A row's fold is a hash of its key.  For each fold a
    tree grows on the other rows; one pass routes all rows through it, which gives the errors of
    every subtree on the rows left out.  All trees read one encoded table, but for a fold whose
    other rows lack a level: these are encoded anew.  The subtree for a price of the main sequence is taken
    at the geometric mean of that price and the next.  With ``one_se`` the smallest subtree
    within one standard error of the best is chosen, else the best.  Rows that lack a target, a
    number or a category are left out.  Needs at least one row in two folds; where the table
    is too small for that, the grown tree stands unvalidated.
    """
    rows = train.dropna(subset=[target, *predictors])
    middle = rows.agg(F.avg(F.col(target).cast("double"))).first()[0]
    if middle is None:
        raise ValueError("no complete row to grow a tree on")
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(folds))
    encoded = encode(rows.withColumn("__fold", fold), predictors, [target, "__fold"])
    main = grow(rows, target, predictors, middle, encoded, seed=seed, **options)
    lacking = folds_without(rows.withColumn("__fold", fold), encoded.levels, "__fold")
    alphas = [p.alpha for p in main.sequence] + [math.inf]
    prices = [math.sqrt(a * b) if b < math.inf else math.inf for a, b in zip(alphas, alphas[1:])]
    errors, counts = [], []
    for k in range(folds):
        others = rows.where(fold != k)
        if others.isEmpty():
            continue
        same = None if k in lacking else encoded.where(F.col("__fold") != k)
        fit = fit_tree(others, target, predictors, seed=seed, encoded=same, **options)
        shape = shape_of(fit.tree.toDebugString)
        if same is None:
            scored = fit.score(rows.withColumn("__out", fold == k))
        else:
            scored = fit.tree.transform(encoded.rows.withColumn("__out", F.col("__fold") == k))
        grown, unseen = leaf_sums(scored, target, shape.n_leaves, middle, "__out")
        n = float(unseen[:, 0].sum())
        if n == 0:
            continue
        sequence = weakest_links(shape, grown)
        # Prices of a fold are per total error of its rows; put them on the main tree's scale.
        share = float(grown[:, 0].sum()) / float(main.sums[:, 0].sum())
        row = []
        for price in prices:
            best = max(i for i, p in enumerate(sequence) if p.alpha <= price * share)
            row.append(held_out_error(shape, grown, unseen, sequence[best]))
        errors.append(row)
        counts.append(n)
    if len(errors) < 2:
        return main
    held, size = np.array(errors), np.array(counts)
    mean = held.sum(axis=0) / size.sum()
    each = held / size[:, None]
    se = each.std(axis=0, ddof=1) / math.sqrt(len(size))
    best = int(np.argmin(mean))
    limit = mean[best] + (se[best] if one_se else 0.0)
    chosen = max(i for i in range(len(mean)) if mean[i] <= limit)
    return PrunedTree(
        main.grown,
        main.shape,
        main.sums,
        middle,
        main.sequence,
        tuple(mean.tolist()),
        tuple(se.tolist()),
        chosen if one_se else best,
    )
