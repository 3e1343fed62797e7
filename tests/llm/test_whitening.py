"""Whitening against NumPy on exact integers, odd rows and several lengths."""

import numpy as np
import pytest

from valuelab.llm import whitening


def brute(rows, components=8):
    """vec_id -> (n, deviation, whitened, explained) from whole matrices, one list of each length."""
    out = {}
    for d in {len(v) for _, v in rows}:
        ids = [i for i, v in rows if len(v) == d]
        x = np.floor(np.array([v for _, v in rows if len(v) == d], float) * 1024).astype(np.int64) + 100_000
        n = len(x)
        exact = [[int(e) * n - int(s) for e, s in zip(r, x.sum(0))] for r in x]
        away = np.array([[e / n for e in r] for r in exact])
        v = away.T @ away / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        use = e > 1e-12 * e[0]
        for i, r, a in zip(ids, exact, away):
            out[i] = (n, sum(c * c for c in r), (a @ u / np.sqrt(np.where(use, e, 1)))[use], e[use] / (np.trace(v) or 1))
    return out


def test_polarisation_is_exact():
    r = np.random.default_rng(0)
    for y in (r.integers(-9000, 9000, (50, 7)), r.integers(-(2**40), 2**40, (30, 4)), np.zeros((0, 3), np.int64)):
        got = whitening.squares(y)
        rows = [[int(v) for v in row] for row in y]
        d = y.shape[1]
        want = [sum(row[i] ** 2 for row in rows) for i in range(d)]
        want += [sum((row[i] + row[j]) ** 2 for row in rows) for i in range(d) for j in range(i + 1, d)]
        assert got == want
        if len(rows):
            n, rest = len(rows), [sum(row[i] for row in rows) for i in range(d)]
            v = whitening.covariance(n, rest, got)
            assert np.allclose(v, np.cov(y.astype(float).T, bias=True), rtol=1e-9)


def test_deviations_beyond_a_long():
    assert whitening.deviations(np.array([[2**31, 1], [3, 4]])) == [2**62 + 1, 25]
    assert whitening.deviations(np.array([[2**32, 0], [3, 4]], object)) == [None, 25]


def check(got, rows):
    want = brute(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == {i for i, w in want.items() if len(w[2])}
    signs = {}
    for i, parts in by_id.items():
        n, deviation, white, share = want[i]
        assert sorted(parts) == list(range(1, len(white) + 1))
        for c, r in parts.items():
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.explained - share[c - 1]) < 1e-9 and 0 <= r.identity_error < 1e-6
            if abs(white[c - 1]) > 1e-3:
                sign = signs.setdefault((n, len(white), c), np.sign(r.whitened * white[c - 1]))
                assert abs(r.whitened * sign - white[c - 1]) < 1e-6


@pytest.mark.parametrize("most", [1 << 22, 5])
def test_whitening_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(whitening, "MODEL_NUMBERS", most)
    monkeypatch.setattr(whitening._blocks, "__defaults__", (most,))
    r = np.random.default_rng(7)
    mix = r.normal(size=(12, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, (r.normal(size=12) @ mix).tolist()) for i in range(300)]
    rows += [(500 + i, r.normal(size=3).tolist()) for i in range(20)]
    rows += [(600, [1.0, 2.0]), (601, [5.0])]
    odd = [
        (900, None),
        (901, []),
        (902, [None] + [1.0] * 11),
        (903, [float("nan")] + [1.0] * 11),
        (904, [float("-inf")] + [1.0] * 11),
        (905, [1e300] * 12),
    ]
    df = spark.createDataFrame(
        [(i, v, 1, "d") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, dims string"
    )
    check(whitening.whiten(df.repartition(3)).collect(), rows)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert sorted(str(r.vec_id) for r in got) == ["1"] * 4 + ["2"] * 2 + ["None"] * 2
    # equal vectors have no spread
    assert whitening.whiten(spark.createDataFrame([rows[0]] * 3, df.schema)).count() == 0
    empty = whitening.whiten(df.limit(0))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
