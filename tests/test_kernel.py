import numpy as np

from facetlake.operators import classify, kernel


def test_kernel_classifier(spark):
    rng = np.random.default_rng(2)
    middle = [rng.normal(size=128) * 3, rng.normal(size=128) * 3]
    rows = [(i, (middle[i % 2] + rng.normal(scale=0.3, size=128)).tolist(), i % 2 + 4) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, [0.0] * 128, -1)], "id long, v array<double>, label int")
    made = kernel.train(df, "v", "label")
    got = {r.query_id: r for r in kernel.predict(df.where("label > 0"), made, "id", "v").collect()}
    assert all(got[i].cluster == y and got[i].confidence > 0.5 for i, _, y in rows)
    votes = kernel.predict(df.where("id < 4"), made, "id", "v")
    assert {r.query_id: r.predicted for r in classify.weighted_vote(votes, {"svm": 0.3}).collect()} == {0: 4, 1: 5, 2: 4, 3: 5}
    assert kernel.train(df.where("label = 4"), "v", "label") is None
