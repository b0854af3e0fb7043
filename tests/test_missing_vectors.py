"""Rows without a vector, with a null in it or of another size, and changes and tags that repeat."""

import numpy as np

from facetlake.operators import classify, index, kernel, records, search, stores

SHAPE = "id long, v array<double>, label int"


def faces(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(6)[i % 3] + 0.05 * rng.standard_normal(6)).tolist(), i % 3) for i in range(30)]
    odd = [(100, None, 0), (101, [], 0), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (103, [1.0, 2.0], 2)]
    return spark.createDataFrame(rows, SHAPE), spark.createDataFrame(rows + odd, SHAPE)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_searches_leave_them_out(spark):
    whole, every = faces(spark)
    assert rows_of(search.top_neighbours(every.orderBy("id"), every, "id", "v", 3)) == rows_of(search.top_neighbours(whole.orderBy("id"), whole, "id", "v", 3))
    assert search.top_neighbours(every.where("v IS NULL"), every, "id", "v", 3).collect() == []
    got, want = (classify.euclidean_shares(f.where("id % 2 = 0"), f, "id", "v", "label", 3) for f in (every, whole))
    assert rows_of(got) == rows_of(want)
    centres = np.eye(6)[:3]
    assert rows_of(index.with_cells(every, centres, "id", "v")) == rows_of(index.with_cells(whole, centres, "id", "v"))


def test_kernel_leaves_them_out(spark):
    _, every = faces(spark)
    model = kernel.train(every, "v", "label", 32)
    made = {r.query_id: r.cluster for r in kernel.predict(every, model, "id", "v").collect()}
    assert made == {i: i % 3 for i in range(30)}


def test_repeated_changes_and_tags(spark):
    log = spark.createDataFrame([("a", 1, "old", "/p", 3, False)], "library_id string, version int, name string, path string, photo_count int, deleted boolean")
    changes = spark.createDataFrame([("a", "new", None), ("a", "newer", 9)], "library_id string, name string, photo_count int")
    made = records.library_versions(log, changes).where("version = 2").collect()
    assert [(r.name, r.path, r.photo_count) for r in made] == [("newer", "/p", 9)]
    tags = spark.createDataFrame([("i", "scene", ["night"], 1), ("i", "scene", ["beach"], 2), ("i", "mood", ["calm"], 1)], "image string, category string, tags array<string>, at int")
    assert stores.tags_by_category(tags, "image", "category", "tags", "at").first().categories == {"scene": ["beach"], "mood": ["calm"]}
    assert stores.tags_by_category(tags, "image", "category", "tags").first().categories == {"scene": ["night"], "mood": ["calm"]}
