"""Records, and cases that the tables of the queries do not hold."""

import datetime

import pytest
from facetlake.operators import albums, classify, clusters, records, stores, workspace
from facetlake.sources.images import scan_images
from pyspark.sql import functions as F


def test_covers_with_paths_as_text(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("u", "x/b.jpg", at(1), 0.5), ("u", "x/a.jpg", at(1), 0.5), ("u", "x/c.jpg", at(0), 0.1), ("v", "y.jpg", at(1), None)]
    photos = spark.createDataFrame(rows, "owner string, path string, ts timestamp, q double")
    got = albums.covers(albums.sessions(photos, "owner", "ts", "path"), "owner", "ts", "path", F.col("q")).collect()
    assert {(r.owner, r.cover) for r in got} == {("u", "x/a.jpg"), ("v", "y.jpg")}


def test_destinations_stay_distinct(spark):
    paths = ["x/a.jpg", "y/a.jpg", "z/a_1.jpg", "w/b", "v/b", "k/a.png", "q/a_1_1.jpg", "u/a.jpg", "x/c_7.jpg"]
    plan = spark.createDataFrame([("p", x) for x in paths] + [("q", "x/a.jpg")], "folder string, path string")
    got = {(r.folder, r.path): r.dest for r in workspace.unique_destinations(plan, "folder", "path").collect()}
    taken, want = set(), {}
    for folder, path in sorted(got):
        name = path.rsplit("/", 1)[1]
        stem, dot, ext = name.partition(".")
        n, own = 0, name
        while (folder, own) in taken:
            n += 1
            own = f"{stem}_{n}{dot}{ext}"
        taken.add((folder, own))
        want[folder, path] = f"{folder}/{own}"
    assert got == want and len(set(got.values())) == len(got)


def test_scan_of_a_root_with_an_apostrophe(spark, tmp_path):
    root = tmp_path / "Bob's photos"
    (root / "output").mkdir(parents=True)
    for name in ("a.jpg", "B.PNG", ".hidden.jpg", "note.txt", "output/x.jpg"):
        (root / name).write_bytes(b"1")
    got = [r.path.rsplit("/", 1)[1] for r in scan_images(spark, str(root)).collect()]
    assert got == ["B.PNG", "a.jpg"]


def test_numbers_of_new_clusters_go_on(spark):
    new = spark.createDataFrame([(1,), (2,)], "id long")
    near = spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    labels = spark.createDataFrame([], "id long, label int")
    got = classify.assign_incrementally(new, near, labels, "id", "label", first_number=7).orderBy("id").collect()
    assert [r.cluster_id for r in got] == ["inc_000007", "inc_000008"]


def test_rows_that_repeat_a_key(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, n int")
    got = {(r.k, r.v) for r in stores.upsert(table, rows, ["k"], [F.desc("n")]).collect()}
    assert got == {(1, "y"), (2, "b"), (3, "z")}
    assert stores.upsert(table, rows, ["k"]).count() == 3
    changes = spark.createDataFrame([(1, "p"), (1, "q"), (2, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in stores.update_clusters(table, changes, "k", "v").select("k", "v").collect()) == [(1, "q"), (2, None)]


def test_nearest_centroid_without_a_direction(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, v array<double>")
    protos = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0])], "label int, centroid array<double>")
    got = {r.id: (r.predicted, r.confidence) for r in classify.nearest_centroid(faces, protos, "id", "v", "label").collect()}
    assert got == {1: (5, 1.0), 2: (None, 0.0), 3: (None, 0.0), 4: (2, pytest.approx(0.707107))}
    none = classify.nearest_centroid(faces, protos, "id", "v", "label", exclude=[5, 2]).collect()
    assert [r.predicted for r in none] == [None] * 4
    with pytest.raises(ValueError):
        classify.nearest_centroid(faces, protos, "id", "v", "label", most=1)


def test_euclidean_shares(spark):
    rows = [(1, [0.0], 1), (2, [1.0], 1), (3, [2.0], 2), (4, [50.0], 3), (5, [0.5], None)]
    faces = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    got = {(r.query_id, r.cluster): r.share for r in classify.euclidean_shares(faces.where("id in (1, 4)"), faces, "id", "v", "label", 2).collect()}
    assert got == {(1, 1): pytest.approx(2 / 3, abs=1e-5), (1, 2): pytest.approx(1 / 3, abs=1e-5), (4, 2): pytest.approx(49 / 97, abs=1e-5), (4, 1): pytest.approx(48 / 97, abs=1e-5)}


def test_libraries(spark):
    log = spark.createDataFrame([(1, 1, "a", 5, False), (2, 1, "b", 6, False)], "library_id long, version long, name string, photo_count long, deleted boolean")
    changes = spark.createDataFrame([(1, "new", None, True), (9, "no", 1, False)], "library_id long, name string, photo_count long, deleted boolean")
    after = records.deleted_libraries(records.library_versions(log, changes), [2])
    now = {r.library_id: (r.name, r.photo_count, r.version, r.deleted) for r in stores.latest(after, ["library_id"], [F.desc("version")]).collect()}
    assert now == {1: ("new", 5, 2, False), 2: ("b", 6, 2, True)}


def test_small_columns(spark):
    df = spark.createDataFrame([("a, b,,c ", "/in/x/../y.jpg"), (None, "/in/../out"), ("1,x,2", "/inn/x"), ("", None), ("7", "in/x")], "t string, p string")
    got = df.select(records.listed(F.col("t")).alias("t"), records.listed(F.col("t"), "int").alias("n"), records.below(F.col("p"), "/in").alias("below")).collect()
    assert [r.t for r in got] == [["a", "b", "c"], [], ["1", "x", "2"], [], ["7"]]
    assert [r.n for r in got] == [[], [], [1, 2], [], [7]]
    assert [r.below for r in got] == [True, False, False, False, False]


def test_sizes_and_names(spark):
    df = spark.createDataFrame([(1, [1.0], -1), (2, [1.0, 2.0], 3), (3, [1.0, 2.0], 3), (4, None, None)], "id long, v array<double>, label int")
    assert records.common_size(df, "v").first().size == 2
    assert records.common_size(df.limit(0), "v").first().size is None
    assert [r.name for r in clusters.named(df.where("label is not null"), "id", "label").orderBy("id").collect()] == ["noise_1", "cluster_3", "cluster_3"]
    r = records.face_counts(df, "label", "id").first()
    assert (r.faces, r.images, r.clusters) == (4, 4, 1)
