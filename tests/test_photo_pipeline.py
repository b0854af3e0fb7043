import numpy as np
import pytest

from facetlake.config import from_toml, settings
from facetlake.plans import photo_pipeline

BOX = "struct<top:int,right:int,bottom:int,left:int>"


def test_settings():
    s = settings(from_toml("[clustering]\neps = 0.7\n[output]\nmulti_face_strategy = 'all'"), {"eps": 0.9, "merge_threshold": None})
    assert (s.eps, s.multi_face_strategy, s.merge_threshold) == (0.9, "all", 0.8)
    for bad in ({"eps": 0}, {"merge_threshold": 2}, {"cluster_method": "x"}, {"nothing": 1}, {"min_samples": 0}):
        with pytest.raises(ValueError):
            settings(bad)


def test_pipeline(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(size=32), rng.normal(size=32)
    images = [(f"/p/{i}.jpg", 640, 480, "broken" if i == 9 else None, False) for i in range(11)]
    faces = []
    for i in range(8):
        faces.append((f"/p/{i}.jpg", 0, (100, 300, 300, 100), 0.9, 0.8, (a if i < 4 else b) + rng.normal(scale=0.02, size=32)))
    faces.append(("/p/0.jpg", 1, (0, 60, 60, 0), 0.9, 0.8, b))  # a second, smaller face
    faces.append(("/p/1.jpg", 1, (0, 60, 60, 0), 0.2, 0.8, b))  # not sure enough
    faces.append(("/p/8.jpg", 0, (0, 90, 90, 0), 0.9, 0.8, rng.normal(size=32)))  # nobody
    rows = [(*f[:5], None if f[5] is None else [float(x) for x in f[5]]) for f in faces]
    df = spark.createDataFrame(rows, f"path string, face_index int, box {BOX}, confidence double, quality double, embedding array<double>")
    im = spark.createDataFrame(images, "path string, width int, height int, error string, skipped boolean")
    made = photo_pipeline.run(im, df, settings({"include_unclustered": True, "include_no_faces": True}))
    plan = {(r.folder, r.path) for r in made.plan.collect()}
    assert plan == {("person_00", f"/p/{i}.jpg") for i in range(4)} | {("person_01", f"/p/{i}.jpg") for i in range(4, 8)} | {
        ("_unclustered", "/p/8.jpg"),
        ("_no_faces", "/p/10.jpg"),
    }
    assert all(r.confidence > 0.9 for r in made.confidences.collect())
    every = photo_pipeline.run(im, df, settings({"multi_face_strategy": "all"}))
    got = {(r.folder, r.path) for r in every.plan.collect()}
    assert ("person_01", "/p/0.jpg") in got and ("person_01", "/p/1.jpg") not in got and not any(f[0] == "_" for f, _ in got)


def test_when_to_optimise():
    assert photo_pipeline.should_optimise(1, 0, force=True)
    assert not photo_pipeline.should_optimise(50, 9000) and photo_pipeline.should_optimise(6000, 5000)


def test_clustering_anew(spark):
    rng = np.random.default_rng(3)
    faces = [(f"f{i}", (np.eye(8)[i % 2] + rng.normal(scale=0.01, size=8)).tolist(), np.eye(4)[i // 6].tolist(), 0) for i in range(12)]
    df = spark.createDataFrame(faces, "face_id string, embedding array<double>, head array<double>, label int")
    s = settings({"eps": 0.1, "min_samples": 2, "merge_threshold": 1.0, "small_merge_threshold": 1.0})
    made, names = photo_pipeline.recluster(df, s, {0: "Ann", 1: "Bo", 2: "Cy", 3: "Di", 9: "gone"})
    assert made.select("label").distinct().count() == 2 and names == {0: "Ann", 1: "Bo"}
    made, names = photo_pipeline.recluster(df, s, {0: "Ann", 3: "Di", 9: "gone"}, head_col="head", weight=0.2)
    got = {}
    for r in made.collect():
        got.setdefault(r.label, set()).add(r.face_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(f"f{i}" for i in range(12) if (i % 2, i // 6) == k) for k in [(0, 0), (0, 1), (1, 0), (1, 1)])
    assert names == {0: "Ann", 3: "Di"}
    for bad in (df.limit(1), df.withColumn("embedding", df.embedding).where("face_id in ('f0', 'f1')")):
        with pytest.raises(ValueError):
            photo_pipeline.recluster(bad, s, {})


def test_hierarchical_method(spark):
    rng = np.random.default_rng(5)
    faces = [(f"f{i}", f"/p/{i}.jpg", (np.eye(8)[i % 2] + rng.normal(scale=0.01, size=8)).tolist(), np.eye(4)[i // 6].tolist(), 0) for i in range(12)]
    df = spark.createDataFrame(faces, "face_id string, path string, embedding array<double>, head array<double>, label int")
    s = settings({"cluster_method": "hdbscan", "min_cluster_size": 3})
    made = {r.face_id: r.label for r in photo_pipeline.cluster_faces(df.drop("label"), s).collect()}
    assert len({made[f"f{i}"] for i in range(0, 12, 2)}) == 1 == len({made[f"f{i}"] for i in range(1, 12, 2)}) and made["f0"] != made["f1"]
    both, _ = photo_pipeline.recluster(df, s, {}, "head", 0.5)
    assert {"label", "probability"} <= set(both.columns) and both.count() == 12
    for bad in ({"min_cluster_size": 1}, {"cluster_selection_method": "x"}, {"cluster_selection_epsilon": -1}):
        with pytest.raises(ValueError):
            settings(bad)
