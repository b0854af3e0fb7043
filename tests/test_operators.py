import datetime as dt
import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.functions import boxes, calendar, quality
from facetlake.functions.vectors import blended, cosine, dot, norm, padded, unit
from facetlake.operators import albums, classify, clusters, density, search, stores, workspace
from facetlake.sources.images import scan_images


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def vec(v):
    return F.array(*[F.lit(float(x)) for x in v])


def faces(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], int(label)) for i, v, label in rows], "id long, v array<double>, label int")


# -- vectors, boxes, quality ------------------------------------------------------


def test_vectors(spark):
    got = one(spark, dot(vec([1, 2]), vec([3, 4])), norm(vec([3, 4])), unit(vec([3, 4])), cosine(vec([0, 0]), vec([1, 1])), padded(vec([1]), 3))
    assert got == (11.0, 5.0, [0.6, 0.8], 0.0, [1.0, 0.0, 0.0])
    assert one(spark, dot(vec([1]), vec([1, 2])))[0] is None
    with pytest.raises(Exception, match="longer"):
        one(spark, padded(vec([1, 2]), 1))
    assert one(spark, blended(F.lit(0.5), F.lit(1.0), 0.2), blended(F.lit(0.5), F.lit(None).cast("double"), 0.2), blended(F.lit(3.0), F.lit(0.0), 0)) == (pytest.approx(0.6), 0.5, 2.0)


def box(t, r, b, l):  # noqa: E741
    return boxes.box(F.lit(t), F.lit(r), F.lit(b), F.lit(l))


def detections(*rows):
    return F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(i).alias("pos"), box(*b).alias("box")) for i, (c, b) in enumerate(rows)])


def test_suppression(spark):
    near = detections((0.7, (12, 112, 112, 12)), (0.9, (10, 110, 110, 10)), (0.6, (14, 114, 114, 14)))
    apart = detections((0.5, (0, 10, 10, 0)), (0.9, (50, 60, 60, 50)))
    ties = detections((0.5, (0, 10, 10, 0)), (0.5, (0, 10, 10, 0)))
    kept = [[d["pos"] for d in one(spark, boxes.suppressed(x))[0]] for x in (near, apart, ties)]
    assert kept == [[1], [1, 0], [0]]
    empty = F.slice(near, 1, 0)
    assert one(spark, boxes.suppressed(empty))[0] == []


def test_boxes(spark):
    assert one(spark, boxes.iou(box(0, 10, 10, 0), box(0, 20, 10, 10)), boxes.iou(box(0, 10, 10, 0), box(0, 10, 10, 0))) == (0.0, 1.0)
    tall, square = one(spark, boxes.shrunk_body(box(0, 50, 200, 0)), boxes.shrunk_body(box(0, 50, 60, 0)))
    assert tall["bottom"] == 100 and square["bottom"] == 60
    flipped = one(spark, boxes.pixels_from_unit(F.lit(0.0), F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(100), F.lit(200)))[0]
    assert tuple(flipped) == (0, 50, 100, 0)
    rows = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.9), ("b", 0, 0.1)], "image string, i int, c double").withColumn("b", box(10, 20, 20, 10))
    made = boxes.primary_faces(rows, "image", "i", F.col("b"), F.col("c"), F.lit(100), F.lit(100)).where("is_primary").orderBy("image").collect()
    assert [(r.image, r.i) for r in made] == [("a", 0), ("b", 0)]


def test_quality(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    good = quality.landmark_quality(p(0, 0), p(40, 0), p(20, 20), p(5, 45), p(35, 45))
    upside = quality.landmark_quality(p(0, 50), p(40, 50), p(20, 20), p(5, 0), p(35, 0))
    close = quality.landmark_quality(p(0, 0), p(0.5, 0), p(0, 1), p(0, 2), p(0, 2))
    missing = quality.landmark_quality(F.lit(None).cast("struct<x:double,y:double>"), p(1, 1), p(1, 1), p(1, 1), p(1, 1))
    assert one(spark, good, upside, close, missing) == (1.0, 0.3, 0.3, 0.4)
    assert one(spark, quality.face_quality(F.lit(400.0), F.lit(0.05)), quality.face_quality(F.lit(0.0), F.lit(0.0005))) == (1.0, 0.0)
    assert one(spark, quality.cluster_quality(F.lit(None).cast("double"), F.lit(10), F.lit(0)))[0] == pytest.approx(0.5)


# -- search -----------------------------------------------------------------------


def test_search_pages_and_filters(spark):
    rows = [(i, [math.cos(a), math.sin(a)], i % 2) for i, a in enumerate(np.linspace(0, 0.6, 11))]
    corpus = faces(spark, rows)
    found = search.search(corpus, [1.0, 0.0], "id", "v", 50, 0.4, exclude=0)
    assert found.count() == 10 and found.orderBy("rank").first().id == 1
    page = search.page_of(found, 2, 3).orderBy("rank").collect()
    assert [r.id for r in page] == [4, 5, 6] and page[0].total == 10
    assert search.search(corpus, [1.0, 0.0], "id", "v", 50, 0.4, where=F.col("label") == 1).count() == 5
    assert search.search(corpus, [1.0, 0.0, 0.0], "id", "v").count() == 0
    near = search.top_neighbours(corpus, corpus, "id", "v", 3, block_rows=4).where("query_id = 5").orderBy("rank").collect()
    assert {near[0].id, near[1].id} == {4, 6} and len(near) == 3
    assert search.active(corpus, corpus.where("id < 3"), "id").count() == 8
    assert not search.needs_rebuild(100, 5) and search.needs_rebuild(100, 20)
    with pytest.raises(KeyError):
        search.vector_of(corpus, "id", "v", 99)


# -- clusters ---------------------------------------------------------------------


def blobs(seed=42):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=128), rng.normal(size=128) + 3
    return [(i, (a if i < 10 else b) + rng.normal(scale=0.1, size=128), 0 if i < 10 else 1) for i in range(20)]


def test_dbscan(spark):
    got = {r.id: r.label for r in clusters.dbscan(faces(spark, blobs()), "id", "v", 0.5, 2).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[i] for i in range(10, 20)} == {1}
    rng = np.random.default_rng(99)
    spread = [(i, rng.normal(size=128), 0) for i in range(10)]
    assert {r.label for r in clusters.dbscan(faces(spark, spread), "id", "v", 0.3, 3).collect()} == {-1}


def dbscan_by_hand(u, eps, least):
    near = np.linalg.norm(u[:, None] - u[None], axis=2) <= eps
    core = near.sum(1) >= least
    label = np.full(len(u), -1)
    number = 0
    for s in np.flatnonzero(core):
        if label[s] >= 0:
            continue
        todo = [s]
        while todo:
            x = todo.pop()
            if label[x] < 0:
                label[x] = number
                todo += [y for y in np.flatnonzero(near[x] & core) if label[y] < 0]
        number += 1
    want = label.copy()
    for x in np.flatnonzero(~core):
        beside = label[near[x] & core]
        want[x] = beside.min() if len(beside) else -1
    return want.tolist()


def test_dbscan_like_brute_force(spark):
    m = np.random.default_rng(1).normal(size=(80, 3))
    want = dbscan_by_hand(m / np.linalg.norm(m, axis=1, keepdims=True), 0.35, 4)
    df = faces(spark, [(i, v, 0) for i, v in enumerate(m)])
    for blocks in ({}, {"block_rows": 16, "sample_rows": 40}):
        got = {r.id: r.label for r in clusters.dbscan(df, "id", "v", 0.35, 4, **blocks).collect()}
        assert [got[i] for i in range(80)] == want


@pytest.mark.parametrize("seed,eps,least", [(3, 0.1, 4), (5, 0.5, 6)])
def test_dbscan_of_dense_groups_over_many_cells(spark, seed, eps, least):
    """Copies, kernels, chains and scattered points, in many small cells and blocks, with points at the origin and without a vector."""
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 1.5, 40)
    m = np.vstack([
        np.repeat(rng.normal(size=(3, 4)), 25, axis=0),
        rng.normal(size=4) + rng.normal(scale=0.02, size=(60, 4)),
        np.stack([np.cos(turn), np.sin(turn), 0 * turn, 0 * turn], axis=1),
        rng.normal(size=(120, 4)),
        np.zeros((5, 4)),
    ])
    m = m[rng.permutation(len(m))]
    want = dbscan_by_hand(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10), eps, least)
    df = faces(spark, [*[(i, v, 0) for i, v in enumerate(m)], (1000, [0.0], 0)]).withColumn("v", F.when(F.col("id") < 1000, F.col("v")))
    rows = clusters.dbscan(df, "id", "v", eps, least, block_rows=40, sample_rows=100).collect()
    got = {r.id: r.label for r in rows}
    assert len(rows) == len(m) + 1 and got[1000] == -1
    assert [got[i] for i in range(len(m))] == want
    assert clusters.dbscan(df.limit(0), "id", "v", eps, least).collect() == []


def test_dbscan_compares_few_pairs(spark, monkeypatch):
    """Vectors spread evenly, where no cells can be left out: samples decide most nodes, and the clusters stay exact."""
    compared = []
    made = density._meeting

    def counted(*args):
        meet = made(*args)
        return lambda left, right, count, total, *more: compared.append(count * total) or meet(left, right, count, total, *more)

    monkeypatch.setattr(density, "_meeting", counted)
    n = 400
    m = np.random.default_rng(11).standard_normal((n, 3))
    got = {r.id: r.label for r in clusters.dbscan(faces(spark, [(i, v, 0) for i, v in enumerate(m)]), "id", "v", 0.8, 3, block_rows=20, sample_rows=100).collect()}
    assert [got[i] for i in range(n)] == dbscan_by_hand(m / np.linalg.norm(m, axis=1, keepdims=True), 0.8, 3)
    assert 0 < sum(compared) < n * n / 2


def test_centroids_confidence_mapping_merge(spark):
    df = faces(spark, [*blobs(), (50, np.ones(128), -1)])
    made = {r.label: r for r in clusters.centroids(df, "label", "v").collect()}
    assert set(made) == {0, 1} and made[0].member_count == 10 and np.linalg.norm(made[0].centroid) == pytest.approx(1)
    assert all(r.confidence > 0.9 for r in clusters.confidences(df, "label", "v").collect())
    assert clusters.confidences(faces(spark, [(1, [1, 0], 3)]), "label", "v").first().confidence == 1.0
    paths = {r.label: r.paths for r in clusters.mapping(df.withColumn("path", F.concat(F.lit("p"), (F.col("id") % 2).cast("string"))), "label", "path").collect()}
    assert paths == {0: ["p0", "p1"], 1: ["p0", "p1"]}
    split = df.withColumn("label", F.when(F.col("id") < 5, 7).otherwise(F.col("label")))
    new = clusters.merged_labels(split, "label", "v")
    assert new[0] == new[7] != new[1] and new[-1] == -1


def test_eps_and_drift(spark):
    curve = spark.createDataFrame([(i, 0.1 if i < 8 else 0.1 + 0.4 * (i - 7)) for i in range(10)], "position long, distance double")
    assert clusters.elbow(curve).first().eps == pytest.approx(0.1)
    assert clusters.elbow(curve.limit(0)).first().eps == 0.5
    t = lambda m: spark.createDataFrame(list(m.items()), "id string, c string")
    old = {"a": "1", "b": "1", "c": "2", "d": "4"}
    assert clusters.drift(t(old), t(old), "id", "c").first().drift == 0
    assert clusters.drift(t(old), t({k: "x" + v for k, v in old.items()}), "id", "c").first().drift == 1
    half = clusters.drift(t(old), t({"a": "1", "b": "1", "c": "9", "d": "9"}), "id", "c").first()
    assert (half.drift, half.new_clusters) == (0.5, 1)
    assert clusters.drift(t(old), t({"z": "1"}), "id", "c").first().drift == 0


# -- classification ---------------------------------------------------------------


def test_incremental_assignment(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(size=32)
    known = faces(spark, [(i, a + rng.uniform(-0.05, 0.05, 32), 7) for i in range(3)] + [(3, rng.normal(size=32), 8)])
    new = faces(spark, [(10, a, -1), (11, -a, -1)])
    near = search.top_neighbours(new, known, "id", "v", 3)
    got = {r.id: r for r in classify.assign_incrementally(new, near, known, "id", "label").collect()}
    assert (got[10].method, got[10].cluster_id) == ("high", "7")
    assert got[11].method == "new_cluster" and got[11].cluster_id == "inc_000000" and got[11].confidence == 1.0
    none = classify.assign_incrementally(new, near.limit(0), known, "id", "label").orderBy("id").collect()
    assert [r.cluster_id for r in none] == ["inc_000000", "inc_000001"]


def test_votes_and_weights(spark):
    v = spark.createDataFrame([(1, "a", 5, 0.9), (1, "b", 6, 0.9), (2, "a", 5, 0.1), (2, "a", 6, 0.1), (2, "a", 7, 0.1)], "query_id int, method string, cluster int, confidence double")
    got = {r.query_id: r.predicted for r in classify.weighted_vote(v, {"a": 0.5, "b": 0.2}).collect()}
    assert got == {1: 5, 2: None}
    actions = lambda *a: F.array(*[F.lit(x) for x in a]).cast("array<string>")
    assert one(spark, classify.adapted_threshold(actions(*["split"] * 20)), classify.adapted_threshold(actions("merge")), classify.adapted_threshold(actions()))[1:] == (pytest.approx(0.68), 0.7)
    up_down = one(spark, classify.adapted_threshold(actions(*["split"] * 20, *["merge"] * 3)))[0]
    assert up_down == pytest.approx(0.89)


def test_thresholds_of_any_length_are_composed(spark):
    """Against the fold, with one owner over many tasks and runs, and owners without any move."""
    rnd = random.Random(5)
    rows = [(0 if i % 3 else rnd.choice([1, 2, None]), i, rnd.choices(["merge", "split", "none", None], [4, 4, 1, 1])[0]) for i in range(3000)]
    rows += [(7, 0, "none"), (8, 0, "split")]
    df = spark.createDataFrame(rows, "owner int, seq int, action string").repartition(5)
    want = {}
    for owner, _, action in sorted(rows, key=lambda r: r[1]):
        t, m, s = want.get(owner, (0.7, 0, 0))
        want[owner] = (max(t - 0.02, 0.4), m + 1, s) if action == "merge" else (min(t + 0.02, 0.95), m, s + 1) if action == "split" else (t, m, s)
    for width in (4, 64, 4096):
        got = {r.owner: (r.threshold, r.merges, r.splits) for r in classify.adapted_thresholds(df, "owner", ["seq"], F.col("action"), width=width).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want), width
    assert classify.adapted_thresholds(df.limit(0), "owner", ["seq"], F.col("action")).count() == 0
    with pytest.raises(ValueError, match="two steps"):
        classify.adapted_thresholds(df, "owner", ["seq"], F.col("action"), width=1)


# -- albums -----------------------------------------------------------------------

DAY = dt.datetime(2024, 6, 15, 9)


def photos(spark, times, owner=1):
    return spark.createDataFrame([(owner, i, t) for i, t in enumerate(times)], "user int, photo int, ts timestamp_ntz")


def event_sizes(spark, times, gap):
    made = albums.events(albums.sessions(photos(spark, times), "user", "ts", "photo", gap), "user", "ts", "photo")
    return [r.photo_count for r in made.orderBy("event_id").collect()], made


def test_events(spark):
    morning = [DAY + dt.timedelta(minutes=30 * i) for i in range(5)]
    afternoon = [DAY.replace(hour=15) + dt.timedelta(minutes=15 * i) for i in range(3)]
    assert event_sizes(spark, morning + afternoon, "4 hours")[0] == [8]  # the gap is exactly four hours
    assert event_sizes(spark, morning + afternoon, "1 hours")[0] == [5, 3]
    trip = [DAY + dt.timedelta(days=d, hours=4 * k) for d in range(5) for k in range(3)]
    assert len(event_sizes(spark, trip, "4 hours")[0]) == 5
    sizes, made = event_sizes(spark, trip, "20 hours")
    assert sizes == [15] and made.first().is_multi_day
    assert event_sizes(spark, trip[:1], "4 hours")[0] == [1]


def test_names_and_growth(spark):
    t = lambda *a: F.lit(dt.datetime(*a))
    names = one(
        spark,
        calendar.event_name(t(2024, 12, 24), t(2024, 12, 26)),
        calendar.event_name(t(2024, 7, 1), t(2024, 7, 3), F.lit("X")),
        calendar.event_name(t(2024, 7, 1), t(2024, 7, 3)),
        calendar.event_name(t(2024, 7, 6), t(2024, 7, 6)),
        calendar.event_name(t(2024, 6, 7), t(2024, 6, 7)),
    )
    assert names == ("2024 年圣诞节", "X (2024-07)", "2024-07-01 ~ 07-03 (3天)", "周末随拍 · 2024-07-06", "2024 年端午节")
    long = photos(spark, [DAY + dt.timedelta(days=60 * i) for i in range(10)])
    row = albums.growth_timelines(long, "user", "ts").first()
    assert row.has_growth_milestone and row.span_months == 17.7
    assert albums.growth_timelines(photos(spark, [DAY] * 6), "user", "ts").count() == 0


def test_people_and_best_faces(spark):
    m = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 1), ("r", 1), ("r", 2), ("r", 3)], "photo string, person int")
    assert {r.photo for r in albums.with_all_people(m, "photo", "person", [1, 2]).collect()} == {"p", "r"}
    assert {r.photo for r in albums.with_all_people(m, "photo", "person", [1, 2], [3]).collect()} == {"p"}
    f = spark.createDataFrame([("a", 0, 100, 0.9, True), ("a", 1, 100, 0.5, False), ("a", 2, 5, 0.8, False), ("b", 0, 9, 0.1, True)], "c string, i int, area int, s double, edge boolean")
    best = albums.best_faces(f, "c", "i", F.col("area"), F.col("s"), F.col("edge")).collect()
    assert {(r.c, r.i) for r in best} == {("a", 1), ("b", 0)}


# -- stores and workspace ---------------------------------------------------------


def test_stores(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in stores.upsert(t, spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "x"), (3, "c")}
    changed = stores.update_clusters(t, spark.createDataFrame([(1, None)], "k int, v string"), "k", "v")
    assert {tuple(r) for r in changed.collect()} == {(1, None), (2, "b")}
    assert stores.delete(t, t.where("k = 1"), "k").count() == 1
    entries = spark.createDataFrame([(i, DAY + dt.timedelta(minutes=20 * i), 10) for i in range(10)], "k int, ts timestamp, size int")
    assert stores.evict(entries, "size", "ts", "k", 100).count() == 10
    assert {r.k for r in stores.evict(entries, "size", "ts", "k", 90).collect()} == set(range(3, 10))
    tags = spark.createDataFrame([("i", ["x", "y"]), ("j", ["x"])], "image string, tags array<string>")
    assert [tuple(r) for r in stores.tag_counts(stores.tag_index(tags, "image", "tags")).collect()] == [("x", 2), ("y", 1)]


def test_workspace(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("n", -1)], "photo string, cluster int")
    state = lambda log: dict(workspace.apply_operations(m, log).collect())
    log = [{"kind": "merge", "from": 1, "to": 2}, {"kind": "remove", "from": 2, "photos": ["c"]}, {"kind": "move", "from": -1, "to": 5, "photos": ["n"]}]
    assert state(log) == {"a": 2, "b": 2, "c": -1, "n": 5}
    assert state(workspace.undo(log)) == {"a": 2, "b": 2, "c": -1, "n": -1}
    assert state(workspace.undo(log, 9)) == dict(m.collect())
    assert workspace.next_cluster_id(m).first()[0] == 3 and workspace.next_cluster_id(m.limit(0)).first()[0] == 0
    assert [r.photo for r in workspace.noise_photos(m, m).collect()] == ["n"]
    plan = spark.createDataFrame([("f", "/x/a.jpg"), ("f", "/y/a.jpg"), ("f", "/y/.b")], "folder string, path string")
    assert sorted(r.dest for r in workspace.unique_destinations(plan, "folder", "path").collect()) == ["f/.b", "f/a.jpg", "f/a_1.jpg"]


def test_scan(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.txt", ".d.jpg", "sub/e.heic", ".hid/f.jpg", "output/g.jpg", "cache/h.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = scan_images(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.jpg", "b.PNG", "e.heic"]
    assert rows[0].fingerprint == f"5:{int((tmp_path / 'a.jpg').stat().st_mtime)}"


def test_numbers_in_order(spark):
    from facetlake.operators.numbering import numbered_in_order

    rows = spark.range(0, 500).selectExpr("(id * 7919) % 500 as id").repartition(5)
    got = numbered_in_order(rows, ["id"], "n")
    assert got.where("id <> n").count() == 0 and got.count() == 500
    assert numbered_in_order(rows.limit(0), ["id"], "n").count() == 0


def test_export_preview_and_names(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", -1), *[(f"p{i}", 3) for i in range(7)]], "photo string, cluster int")
    f = spark.createDataFrame([("a", 2, True), ("a", 1, False), ("b", 1, True)], "photo string, cluster int, is_primary boolean")
    assert {tuple(r) for r in workspace.export_members(m, f, "primary").collect()} == {("a", 2), ("b", 1)}
    assert workspace.export_members(m, f, "all", [1]).count() == 2
    rows = {r.cluster: r for r in workspace.preview(m).collect()}
    assert rows[3].first == [f"p{i}" for i in range(5)] and rows[3].more == 2 and rows[1].more == 0
    assert workspace.rename_operations({1: "x", 2: "y"}, 2, "x") == ({1: "x"}, [{"kind": "merge", "from": 2, "to": 1}])
    assert workspace.rename_operations({1: "x"}, 2, "")[0] == {1: "x", 2: ""}
    c = spark.createDataFrame([(1, 0.12345)], "cluster int, confidence double")
    assert '{"cluster":1,"photos":2,"cover":"a","confidence":0.123}' in {r.json for r in workspace.summary(m, c).collect()}


def test_zero_shot(spark):
    from facetlake.functions import zero_shot

    scores = F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))
    scored = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("score")) for n, s in (("b", 0.5), ("a", 0.5), ("c", 0.9))])
    got = one(spark, zero_shot.softmax(scores), zero_shot.best_labels(scored, 2), zero_shot.short_label(F.lit("a photo of a dog")))
    assert sum(got[0]) == pytest.approx(1) and got[0][0] == pytest.approx(math.e / (2 * math.e + 1))
    assert [r["label"] for r in got[1]] == ["c", "a"] and got[2] == "dog"
    tags = one(spark, zero_shot.first_seen_union(F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("array<string>"), F.array(F.lit("y"), F.lit("z"))))[0]
    assert tags == ["x", "y", "z"]
