"""Whitening against exact fractions and plain sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from topolake.llm import queries, whitening as W


def plain(rows, k=16):
    """n, deviations by row, covariance in fractions, of the contract's rules alone."""
    xs = [[math.floor(64.0 * float(c)) + 1_000_000 for c in v] if v is not None and all(c is not None and math.isfinite(c) for c in v) else None for v in rows]
    fit = sorted({tuple(x) for x in xs if x is not None})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    mean = [Fraction(t, n) for t in s]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return n, s, xs, fit, cov


def check(spark, rows, schema="vec_id long, embedding array<double>", k=16):
    got = W.whiten(spark.createDataFrame(list(enumerate(rows)), schema), k).collect()
    n, s, xs, fit, cov = plain(rows)
    d = len(s)
    m = min(k, d)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i, x in enumerate(xs) if x is not None for c in range(1, m + 1)]
    values = sorted(np.linalg.eigvalsh(np.array([[float(x) for x in row] for row in cov])), reverse=True)
    trace = float(sum(cov[i][i] for i in range(d)))
    for r in got:
        deviation = sum((n * a - b) ** 2 for a, b in zip(xs[r.vec_id], s, strict=True))
        assert r.n == n and (r.deviation if deviation < 1 << 63 else int(r.deviation_over)) == deviation
        assert math.isclose(r.explained, max(values[r.component - 1], 0) / trace, rel_tol=1e-9, abs_tol=1e-12)
        assert r.identity_error <= 1e-6
    return got, cov, xs, s, n


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [list(map(float, v)) for v in r.normal(size=(40, 5))]
    rows += [None, rows[0], rows[0], [0.1, None, 0.2, 0.3, 0.4], [0.1, math.nan, 0.2, 0.3, 0.4], [math.inf, 0.0, 0.0, 0.0, 0.0]]
    got, cov, xs, s, n = check(spark, rows)
    assert n == 40
    # z z' summed over rows undoes the covariance: each row's squared length is its Mahalanobis distance
    inverse = np.linalg.inv(np.array([[float(x) for x in row] for row in cov]))
    for i in (0, 3, 7):
        z = np.array([x.whitened for x in sorted((x for x in got if x.vec_id == i), key=lambda x: x.component)])
        c = np.array([float(a - Fraction(b, n)) for a, b in zip(xs[i], s, strict=True)])
        assert math.isclose(z @ z, c @ inverse @ c, rel_tol=1e-9)


def test_entries_of_any_size_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [[float(a), float(b), float(c)] for a, b, c in zip(r.normal(size=60) * 1e12, r.normal(size=60) * 1e3, r.integers(-(2**50), 2**50, 60), strict=True)]
    check(spark, rows)


def test_scatter_over_many_tasks_is_exact(spark):
    r = np.random.default_rng(3)
    y = r.integers(-(2**61), 2**61, (9000, 3))
    y[:5000] >>= 45
    rows = [(i, v.astype("<i8").tobytes()) for i, v in enumerate(y)]
    n, sums, exact = W.scatter(spark.createDataFrame(rows, "key long, y binary").repartition(5), 3)
    want = y.astype(object)
    assert n == 9000 and sums == want.sum(axis=0).tolist()
    assert exact == (9000 * (want.T @ want) - np.outer(want.sum(axis=0), want.sum(axis=0))).tolist()


def test_no_spread_and_few_dimensions(spark):
    one = W.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}


def test_empty_tables_and_other_lengths(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(none).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 5), (None, [3.0, 1.0], 5), (3, [1.0], 5), (4, [2.0, 2.0], 5)], "vec_id long, embedding array<float>, n int")
    assert sorted((r.vec_id or -1, r.component) for r in W.whiten(mixed).collect()) == [(-1, 1), (-1, 2), (1, 1), (1, 2), (4, 1), (4, 2)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    got = queries.op12_whitening(spark, f"/root/testdata/{sf}").collect()
    n, s, xs, fit, cov = plain([r.embedding for r in rows])
    at = {r.vec_id: x for r, x in zip(rows, xs, strict=True)}
    assert len(got) == 16 * len(rows)
    cov = np.array([[float(x) for x in row] for row in cov])
    values, vectors = np.linalg.eigh(cov)
    for r in got:
        x = at[r.vec_id]
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        e, v = values[-r.component], vectors[:, -r.component]
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        assert math.isclose(abs(r.whitened), abs(centred @ v) / e**0.5, rel_tol=1e-6, abs_tol=1e-8)
        assert math.isclose(r.explained, e / np.trace(cov), rel_tol=1e-9) and r.identity_error < 1e-9
