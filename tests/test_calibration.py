"""Isotonic blocks against the max-min formula."""

import numpy as np
import pytest

from valuelab.models import calibration


def brute(x, y):
    """Score -> fitted value: the greatest over all starts of the least mean over all ends."""
    values = np.unique(x)
    n = np.array([(x == v).sum() for v in values])
    t = np.array([y[x == v].sum() for v in values])
    fit = {}
    for k in range(len(values)):
        fit[values[k]] = max(
            min(t[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(values))) for i in range(k + 1)
        )
    return fit


def test_pool():
    first, n, total = calibration.pool(np.array([1.0, 1, 2, 1]), np.array([3.0, 1, 4, 9]))
    assert (first.tolist(), n.tolist(), total.tolist()) == ([0, 3], [4, 1], [8, 9])


@pytest.mark.parametrize("partitions", [None, 1, 9])
@pytest.mark.parametrize("kind", ["rising", "noise", "falling"])
def test_blocks_against_brute_force(spark, partitions, kind):
    r = np.random.default_rng(4)
    x = r.integers(0, 60, 700) / 4
    slope = {"rising": x / 16, "noise": 0.4 + 0 * x, "falling": 1 - x / 16}[kind]
    y = (r.random(700) < slope).astype(int)
    rows = [(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (1.0, None), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "s double, t int").repartition(3)
    blocks = calibration.isotonic_blocks(df, "t", "s", partitions)
    held = sorted(blocks.collect())
    want = brute(x, y)
    assert sum(b.n for b in held) == 700
    assert all(a.high < b.low and a.value < b.value for a, b in zip(held, held[1:]))
    for v, f in want.items():
        own = [b.value for b in held if b.low <= v <= b.high]
        assert len(own) == 1 and abs(own[0] - f) < 1e-12
    scored = calibration.calibrate(df, blocks, "s").collect()
    for row in scored:
        if row.s is None or np.isnan(row.s):
            assert row.probability is None
        else:
            assert abs(row.probability - want[row.s]) < 1e-12
    ends = calibration.calibrate(spark.createDataFrame([(-9.0,), (99.0,)], "s double"), blocks, "s").collect()
    assert [r.probability for r in ends] == [held[0].value, held[-1].value]


def test_no_rows(spark):
    df = spark.createDataFrame([(None, 1)], "s double, t int")
    blocks = calibration.isotonic_blocks(df, "t", "s")
    assert blocks.count() == 0
    assert calibration.calibrate(df, blocks, "s").first().probability is None
