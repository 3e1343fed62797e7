"""Weakest-link pruning against all subtrees, cross-validation against refitted trees in NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelab.models import pruning, tree


class Cart:
    """Brute-force regression tree on numbers: every threshold midway between neighbours."""

    def __init__(self, x, y, depth, least):
        self.n, self.mean = len(y), float(np.mean(y))
        self.sse = float(((y - self.mean) ** 2).sum())
        self.split = None
        best = (1e-9 * (self.sse + 1), None)
        if depth:
            for j in range(x.shape[1]):
                values = np.unique(x[:, j])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, j] <= cut
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    parts = [y[left], y[~left]]
                    gain = self.sse - sum(((p - p.mean()) ** 2).sum() for p in parts)
                    if gain > best[0]:
                        best = (gain, (j, cut))
        if best[1]:
            self.split = best[1]
            left = x[:, self.split[0]] <= self.split[1]
            self.kids = [Cart(x[m], y[m], depth - 1, least) for m in (left, ~left)]

    def prunings(self):
        """All subtrees with this root, as (error, leaves, predict)."""
        out = [(self.sse, 1, lambda r: self.mean)]
        if self.split:
            j, cut = self.split
            for a, b in itertools.product(*[k.prunings() for k in self.kids]):
                out.append((a[0] + b[0], a[1] + b[1], lambda r, a=a, b=b: (a if r[j] <= cut else b)[2](r)))
        return out

    def best(self, price):
        """The smallest subtree with the least error plus price per leaf."""
        return min(self.prunings(), key=lambda p: (round(p[0] + price * p[1], 6), p[1]))


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    n = 160
    x = np.column_stack([r.uniform(0, 16, n), r.integers(0, 9, n)]).astype(float)
    y = 5.0 * (x[:, 0] > 8) + 2.0 * (x[:, 1] > 4) * (x[:, 0] > 8) + r.normal(0, 1.2, n)
    rows = [(f"k{i}", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    odd = [("o1", None, 1.0, 2.0), ("o2", 1.0, float("nan"), 2.0), ("o3", 1.0, 1.0, None)]
    return spark.createDataFrame(rows + odd, "k string, a double, b double, y double").cache(), x, y


OPTIONS = {"max_depth": 3, "min_rows": 8, "bins": 256}


def test_shape_of_a_printed_tree():
    text = "m\n If (feature 0 <= 1)\n  If (feature 1 <= 2)\n   Predict: 1\n  Else (feature 1 > 2)\n   Predict: 2\n Else (feature 0 > 1)\n  Predict: 3\n"
    shape = pruning.shape_of(text)
    assert shape.children == ((1, 4), (2, 3), (-1, -1), (-1, -1), (-1, -1))
    assert shape.leaves == ((0, 3), (0, 2), (0, 1), (1, 2), (2, 3))
    assert pruning.shape_of("m\n  Predict: 3.0\n").n_leaves == 1


def test_sequence_against_all_subtrees(spark, data):
    df, x, y = data
    rows = df.dropna()
    grown = pruning.grow(rows, "y", ["a", "b"], 1.0, **OPTIONS)
    cart = Cart(x, y, 3, 8)
    everything = cart.prunings()
    assert grown.shape.n_leaves == max(p[1] for p in everything)
    steps = grown.sequence
    assert steps[0].alpha == 0 and steps[-1].n_leaves == 1
    assert [s.n_leaves for s in steps] == sorted((s.n_leaves for s in steps), reverse=True)
    ends = [s.alpha for s in steps[1:]] + [2 * steps[-1].alpha + 1]
    for step, end in zip(steps, ends):
        price = (step.alpha + end) / 2
        error, leaves, _ = cart.best(price)
        assert leaves == step.n_leaves and abs(error - step.sse) < 1e-6


def test_cross_validation_against_refitted_trees(spark, data):
    df, x, y = data
    folds = 3
    fitted = pruning.validated_tree(df, "y", ["a", "b"], "k", folds=folds, **OPTIONS)
    fold = {r.k: r.f for r in df.select("k", F.pmod(F.xxhash64(F.lit(123), "k"), F.lit(folds)).alias("f")).collect()}
    number = np.array([fold[f"k{i}"] for i in range(len(y))])
    alphas = [p.alpha for p in fitted.sequence] + [math.inf]
    held = np.zeros(len(fitted.sequence))
    for k in range(folds):
        inside = number != k
        cart = Cart(x[inside], y[inside], 3, 8)
        for i, (a, b) in enumerate(zip(alphas, alphas[1:])):
            price = math.sqrt(a * b) * inside.mean() if b < math.inf else 1e12
            predict = cart.best(price)[2]
            held[i] += sum((v - predict(r)) ** 2 for r, v in zip(x[~inside], y[~inside]))
    assert np.allclose(fitted.cv_error, held / len(y), rtol=1e-6)
    best = int(np.argmin(held))
    assert fitted.chosen >= best
    table = fitted.table(df).collect()
    assert [r.chosen for r in table].index(True) == fitted.chosen and abs(table[0].cv_error - held[0] / len(y)) < 1e-9
    plain = pruning.validated_tree(df, "y", ["a", "b"], "k", folds=folds, one_se=False, **OPTIONS)
    assert plain.chosen == best


def test_scores_of_the_pruned_tree(spark, data):
    df, x, y = data
    fitted = pruning.validated_tree(df, "y", ["a", "b"], "k", folds=3, **OPTIONS)
    scored = fitted.score(df).collect()
    assert len(scored) == len(y) + 3
    leaves = {}
    for r in scored:
        if r.k.startswith("k"):
            leaves.setdefault(r.leaf, []).append((r.y, r.prediction))
    assert len(leaves) == fitted.sequence[fitted.chosen].n_leaves
    for own in leaves.values():
        assert {round(p, 9) for _, p in own} == {round(float(np.mean([v for v, _ in own])), 9)}
    assert [r.prediction for r in scored if r.k in ("o1", "o2")] == [None, None]


def test_constant_target_and_no_rows(spark, data):
    df, *_ = data
    flat = pruning.validated_tree(df.withColumn("y", F.lit(3.0)), "y", ["a", "b"], "k", folds=3)
    assert [p.n_leaves for p in flat.sequence] == [1] and flat.chosen == 0
    with pytest.raises(ValueError):
        pruning.validated_tree(df.limit(0), "y", ["a", "b"], "k")


def test_fold_trees_ignore_the_rows_left_out(spark, data):
    df, *_ = data
    fit = tree.fit_tree(df.dropna(), "y", ["a", "b"], **OPTIONS)
    assert len(fit.rules()) == pruning.shape_of(fit.tree.toDebugString).n_leaves
