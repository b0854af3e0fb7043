import numpy as np
import pytest
from facetlake.operators import classify, landmark_kernel
from facetlake.plans.ensemble_queries import ensemble_of_three
from pyspark.sql import functions as F

SCHEMA = "id long, v array<double>, label int"


def _rings(n, seed):
    """Three rings around one middle, which no planes tell apart."""
    rng = np.random.default_rng(seed)
    turn, label = rng.uniform(0, 2 * np.pi, n), rng.integers(0, 3, n)
    radius = label * 2 + 1 + rng.normal(scale=0.15, size=n)
    return [(i, [float(r * np.cos(t)), float(r * np.sin(t))], int(y) + 5) for i, (r, t, y) in enumerate(zip(radius, turn, label))]


def test_margins_are_those_of_one_dense_solve(spark):
    rows = _rings(300, 1)
    df = spark.createDataFrame([*rows, (900, [1.0, None], 5), (901, None, 6), (902, [9.0, 9.0], -1), (903, [9.0, 9.0], None), (904, [1.0] * 3, 5)], SCHEMA).repartition(7)
    made = landmark_kernel.train(df.where("id <> 904"), "id", "v", "label", landmarks=50, ridge=0.5)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gamma = 1 / (2 * x.var())
    assert abs(made.basis.gamma - gamma) < 1e-9 and made.labels == [5, 6, 7] and len(made.basis.points) == 50
    kernel = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))
    inner = kernel(made.basis.points, made.basis.points)
    # The same problem the other way round, over rows by rows: the kernel that the landmarks span, and one solve.
    k = kernel(x, made.basis.points)
    q = k @ np.linalg.pinv(inner, rcond=1e-9, hermitian=True) @ k.T
    signs = np.where(y[:, None] == np.array([5, 6, 7]), 1.0, -1.0)
    want = q @ np.linalg.solve(q + 0.5 * np.eye(300), signs)
    got = {r.query_id: r for r in landmark_kernel.predict(df, made, "id", "v").collect()}
    assert set(got) == set(range(300)) | {902, 903}
    for i in range(300):
        assert abs(got[i].margin - want[i].max()) < 1e-5 and got[i].cluster == want[i].argmax() + 5


def test_held_out_rings_and_confidence(spark):
    df = spark.createDataFrame(_rings(900, 2), SCHEMA)
    made = landmark_kernel.train(df, "id", "v", "label", landmarks=80)
    fresh = spark.createDataFrame([(i + 10_000, v, y) for i, v, y in _rings(400, 3)], SCHEMA)
    votes = landmark_kernel.predict(fresh, made, "id", "v")
    both = votes.join(fresh.withColumnRenamed("id", "query_id"), "query_id").select((F.col("cluster") == F.col("label")).cast("int").alias("ok"), "confidence").collect()
    right, sure = np.mean([r.ok for r in both]), np.mean([r.confidence for r in both])
    assert right > 0.97 and abs(right - sure) < 0.1 and made.slope > 1
    assert classify.weighted_vote(votes, {"svm": 0.3}).where("predicted IS NULL").count() < 20


def test_sums_by_many_labels_and_too_few_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), i % 40) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    basis = landmark_kernel.fit_basis(df, "id", "v", 20)
    got = landmark_kernel._sums(df, "v", "label", basis, many=7).collect()
    z = basis.features(np.array([r[1] for r in rows]))
    for r in got:
        want = (z.T @ z)[r.part] if r.label is None else z[[i for i in range(200) if i % 40 == r.label]].sum(0)
        assert np.allclose(r.sums, want) and r.n == (200 if r.label is None else 5)
    assert len(got) == 40 + z.shape[1]
    assert landmark_kernel.train(df.where("label = 4"), "id", "v", "label") is None and landmark_kernel.train(df.limit(0), "id", "v", "label") is None
    same = spark.createDataFrame([(i, [1.0, 1.0], i % 2) for i in range(10)], SCHEMA)
    made = landmark_kernel.train(same, "id", "v", "label")
    assert {r.cluster for r in landmark_kernel.predict(same, made, "id", "v").collect()} == {0}
    with pytest.raises(ValueError, match="more than"):
        landmark_kernel.train(df, "id", "v", "label", landmarks=20, most=10)


def test_the_vote_of_three_arms(spark, tmp_path):
    """New faces whose own labels are wrong: no arm may have learned from them."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(3, 16))
    rows = [(i, (middle[i % 3] + rng.normal(scale=0.1, size=16)).tolist(), 9 if i % 50 == 0 else i % 3) for i in range(1, 301)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: r for r in ensemble_of_three(spark, str(tmp_path)).collect()}
    assert set(got) == {50, 100, 150, 200, 250, 300}
    assert all((r.predicted, r.svm, r.confidence) == (i % 3, i % 3, 1.0) for i, r in got.items())
