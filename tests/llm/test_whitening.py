import math

import numpy as np
import pytest

from storyloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component double"


def brute(vectors):
    """Whole entries, distinct, by a full eigenvalue decomposition."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, found = np.linalg.eigh(c.T @ c / n)
    return x, n, s, values[::-1], found[:, ::-1]


def compare(rows, vectors, components=16):
    x, n, s, values, found = brute(vectors)
    rank = int((values > 1e-12 * values[0]).sum())
    k = min(components, rank)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * k
    for c in range(k):
        want = (x - s / n) @ found[:, c] / np.sqrt(values[c])
        have = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
        sign = np.sign(have @ want)
        assert abs(have * sign - want).max() < 1e-6
        assert got[0, c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    for r in rows:
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s, strict=True)) and r.identity_error < 1e-8


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "own", 1.0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def some(n, d, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)) * np.geomspace(2, 0.1, d)
    return [[float(c) for c in row] for row in np.float32(v)]


def test_by_full_decomposition(spark):
    vectors = some(300, 24)
    vectors += [vectors[0]] * 100  # copies are fitted once
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_more_dimensions_than_rank(spark):
    base = some(9, 20, 2)
    compare(whitening.whiten(frame(spark, base)).collect(), base)


def test_small_blocks_and_restarts(spark):
    vectors = some(200, 40, 3)
    rows = whitening.whole_vectors(frame(spark, vectors))
    model = whitening.fit(rows, 5, block=3)
    _, _, _, values, found = brute(vectors)
    assert np.allclose(model.values, values[:5], rtol=1e-12)
    assert np.allclose(abs(np.sum(model.components * found[:, :5], axis=0)), 1, atol=1e-12)


def test_lanczos_alone():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.r_[np.geomspace(100, 1, 40), np.full(160, 0.5), np.zeros(100)]
    a = (q * values) @ q.T
    for kind in ({"block": 16}, {"block": 2}, {"block": 4, "most": 30}):  # the last shrinks its basis
        got, vectors, passes = whitening.lanczos(lambda x: a @ x, 300, 6, **kind)
        assert np.allclose(got, values[:6], rtol=1e-10) and passes < 300
        assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-10
    # breakdown at once: the start spans an invariant space, as the operator is a multiple of one
    got, vectors, _ = whitening.lanczos(lambda x: 3.0 * x, 10, 10, block=2)
    assert np.allclose(got, 3) and np.allclose(vectors.T @ vectors, np.eye(10))
    low = np.diag([5.0, 4, 0, 0, 0, 0, 0, 0])
    got, _, _ = whitening.lanczos(lambda x: low @ x, 8, 4, block=3)
    assert np.allclose(got, [5, 4, 0, 0], atol=1e-12)


def test_rows_that_go(spark):
    vectors = some(60, 6, 5)
    odd = [None, [], [1.0, 2.0], [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] + [0.0] * 5]
    table = frame(spark, vectors).union(spark.createDataFrame([(900 + i, v, "", 0.0) for i, v in enumerate(odd)], SCHEMA))
    rows = whitening.whiten(table, 4).collect()
    compare(rows, vectors, 4)


def test_no_spread_nulls_and_empty_table(spark):
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]]).limit(0)).count() == 0
    table = spark.createDataFrame([(None, [0.0, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(table).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "None", "None"] and {r.component for r in got} == {1}


def test_entries_beyond_whole_numbers(spark):
    vectors = [[1e30, 0.0], [0.0, 1.0], [-1e30, 2.0]]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.deviation for r in got if r.vec_id != 1} == {None} and all(math.isfinite(r.whitened) for r in got)
