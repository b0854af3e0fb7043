"""Whitening against dense linear algebra on the whole matrix."""

import numpy as np

from facetlake.llm.whitening import covariance, whiten

SHAPE = "vec_id long, embedding array<float>, n long, x string"


def plain(vectors, most=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.unique(x.astype(np.int64), axis=0)
    n, s = len(fit), fit.sum(0)
    d = fit - s / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (x.astype(float) - s / n) @ u / np.sqrt(e), e / np.trace(v)


def compare(spark, vectors, **options):
    df = spark.createDataFrame([(i, [float(c) for c in v], 7, "y") for i, v in enumerate(vectors)], SHAPE)
    rows = whiten(df, **options).collect()
    vectors = [np.array(v, np.float32) for v in vectors]
    n, deviation, w, explained = plain(vectors)
    k = w.shape[1]
    assert len(rows) == len(vectors) * k
    signs = {}
    for r in sorted(rows, key=lambda r: (-abs(w[r.vec_id, r.component - 1]), r.component)):
        want = w[r.vec_id, r.component - 1]
        sign = signs.setdefault(r.component, np.sign(want) * np.sign(r.whitened))
        assert abs(r.whitened - sign * want) < 1e-6 * max(1, abs(want))
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9


def test_whitening_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 20)) * np.linspace(0.2, 4, 20)
    vectors[50:150] = vectors[0]
    compare(spark, vectors)
    compare(spark, vectors, tile=7, block_rows=32)
    compare(spark, rng.standard_normal((40, 3)))


def test_tiles_make_the_whole_matrix(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-(10**6), 10**6, (500, 23))
    fit = spark.createDataFrame([([int(c) for c in r],) for r in x], "x array<long>")
    s = x.sum(0)
    whole, left = s // 500, (s % 500) / 500
    got = covariance(fit, 500, whole, left, tile=5, block_rows=60)
    assert np.allclose(got, np.cov(x.T, bias=True), rtol=1e-12)


def test_what_cannot_be_whitened(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0, "a"), (2, [nan, 1.0], 0, "a"), (3, [None, 1.0], 0, "a"), (4, [inf, 1.0], 0, "a")]
    some = [(5, [0.0, 1.0], 0, "a"), (None, [0.5, 0.25], 0, "a"), (5, [0.0, 1.0], 0, "a"), (6, [1.0], 0, "a"), (7, [], 0, "a")]
    rows = whiten(spark.createDataFrame(odd + some, SHAPE)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in rows) == sorted([(False, i, c) for i in (5, 5, 6, 7) for c in (1, 2)] + [(True, 0, c) for c in (1, 2)])
    assert {r.n for r in rows} == {4}
    for few in ([], odd, some[:1], some[:1] * 3, some[4:]):
        assert whiten(spark.createDataFrame(few, SHAPE)).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e300, 0.5])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(huge).collect()} == {None}
