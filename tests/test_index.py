import numpy as np
import pytest

from facetlake.operators import index, search


def test_recall_of_the_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16))
    rows = [(i, (middle[i % 12] + 0.35 * rng.normal(size=16)).tolist()) for i in range(1200)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    queries = corpus.where("id % 50 = 0")
    centres = index.fit_cells(corpus, "id", "v", cells=12, sample_rows=600)
    path = f"file://{tmp_path}/index"
    index.write_index(corpus, centres, "id", "v", path)
    assert spark.read.parquet(path).count() == 1200
    exact = {(r.query_id, r.id) for r in search.top_neighbours(queries, corpus, "id", "v", 10).collect()}
    found = index.search_index(spark, path, queries, centres, "id", "v", 10, probes=4).collect()
    recall = len(exact & {(r.query_id, r.id) for r in found}) / len(exact)
    assert recall >= 0.9
    every = index.search_index(spark, path, queries, centres, "id", "v", 10, probes=12).collect()
    assert {(r.query_id, r.id) for r in every} == exact


def test_an_index_is_kept_opened_and_rebuilt(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    path = f"file://{tmp_path}/kept"
    index.create(corpus, "id", "v", path, cells=5)
    opened = index.load(spark, path, "id")
    assert len(opened.centres) == 5 and opened.counts() == (200, 200, 0)
    opened.add(spark.createDataFrame([(3, [1.0] + [0.0] * 7), (900, [0.0, 2.0] + [0.0] * 6)], "id long, v array<double>"), "v")
    assert opened.vector_of(3) == [1.0] + [0.0] * 7 and opened.vector_of(900)[:2] == [0.0, 1.0]
    with pytest.raises(KeyError):
        opened.vector_of(-1)
    gone = spark.createDataFrame([(i,) for i in [*range(10, 40), 10, 5000]], "id long")
    assert not opened.needs_rebuild()
    opened.soft_delete(gone)
    opened.soft_delete(gone)
    assert opened.counts() == (202, 172, 30) and opened.needs_rebuild()
    left = corpus.where("id not between 10 and 39").unionAll(spark.createDataFrame([(900, [0.0, 2.0] + [0.0] * 6)], corpus.schema))
    queries = corpus.where("id in (50, 100, 150)")
    exact = {(r.query_id, r.id) for r in search.top_neighbours(queries, left.where("id <> 3"), "id", "v", 5).collect()}
    again = index.load(spark, path, "id").rebuild(f"file://{tmp_path}/new", cells=100)
    assert len(again.centres) == 1 and again.counts() == (172, 172, 0)
    for one in (opened, again):
        got = {(r.query_id, r.id) for r in one.search(queries, "v", 5).where("id <> 3").collect()}
        assert got <= exact and len(got) >= 13
