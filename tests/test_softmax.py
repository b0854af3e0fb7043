import numpy as np
from pyspark.sql import functions as F

from facetlake.functions import vectors, zero_shot


def test_long_arrays_are_summed_once(spark):
    """Work that grows with the cube of the length would not end here."""
    v = np.random.default_rng(1).standard_normal((3, 2000))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(3, []), (4, None)], "id int, v array<double>")
    got = {r.id: r for r in rows.select("id", zero_shot.softmax(F.col("v")).alias("p"), vectors.unit(F.col("v")).alias("u")).collect()}
    for i, x in enumerate(v):
        assert np.allclose(got[i].p, np.exp(x) / np.exp(x).sum()) and np.allclose(got[i].u, x / np.linalg.norm(x))
    assert (got[3].p, got[3].u, got[4].p, got[4].u) == ([], [], None, None)
