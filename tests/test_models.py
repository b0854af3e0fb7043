"""Models that plug in, and plans that are carried out."""

import os

import numpy as np
import pytest
from facetlake.functions.zero_shot import block_results
from facetlake.operators import models, workspace
from pyspark.sql import functions as F

IMAGE = models.IMAGE


def _load_detector():
    def model(pixels):
        if pixels[0, 0, 0] == 7:
            raise RuntimeError("no")
        box = {"top": 0, "left": 0, "right": pixels.shape[1], "bottom": pixels.shape[0]}
        return [(box, 0.9, [[1.0, 2.0]]), (box, 0.1, None), (box | {"right": 3}, 0.9, None)]

    return model


def _load_encoder():
    return lambda pixels, box: None if box is None else np.array([pixels.mean(), box["right"]])


def _images(spark):
    image = lambda v: (50, 60, 1, bytes([v]) * 3000)
    return spark.createDataFrame([("a", image(1)), ("b", image(7)), ("c", (5, 5, 3, b"x")), ("d", None)], f"path string, image {IMAGE}")


def test_detectors(spark):
    got = {r.path: r for r in models.detect(_images(spark), _load_detector).collect()}
    assert [(f.box.right, f.confidence, f.landmarks) for f in got["a"].faces] == [(60, 0.9, [[1.0, 2.0]])] and got["a"].error is None
    assert got["b"].error == "RuntimeError: no" and got["b"].faces is None
    assert got["c"].error == got["d"].error == "image can't be decoded"
    assert models.detect(_images(spark).limit(0), _load_detector).count() == 0


def test_encoders_and_cache(spark):
    boxes = spark.createDataFrame([("a", (1, 9, 9, 1)), ("b", None), ("d", (1, 2, 3, 4))], f"path string, box {models.BOX}")
    faces = _images(spark).join(boxes, "path")
    got = {r.path: (r.embedding, r.error) for r in models.encode(faces, _load_encoder).collect()}
    assert got == {"a": ([1.0, 9.0], None), "b": (None, None), "d": (None, "image can't be decoded")}
    cache = spark.createDataFrame([("d", [5.0]), ("d", [5.0]), ("x", [1.0])], "path string, embedding array<double>")
    again = {r.path: (r.embedding, r.error) for r in models.encode_missing(faces, cache, ["path"], _load_encoder).collect()}
    assert again == got | {"d": ([5.0], None)}


def test_plans_are_carried_out(spark, tmp_path):
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / name).write_text(name)
    rows = [(f"file:{tmp_path}/a.jpg", "person_00/a.jpg"), (f"{tmp_path}/b.jpg", "_no_faces/b.jpg"), (f"{tmp_path}/gone.jpg", "x/gone.jpg")]
    plan = spark.createDataFrame(rows, "path string, dest string")
    out = str(tmp_path / "out")
    assert tuple(workspace.plan_counts(workspace.execute_plan(plan, "path", out, dry_run=True)).first()) == (0, 3, 0)
    assert not os.path.exists(out)
    for _ in range(2):  # again, as a lost task would
        assert tuple(workspace.plan_counts(workspace.execute_plan(plan, "path", out)).first()) == (2, 0, 1)
    assert (tmp_path / "out/person_00/a.jpg").read_text() == "a.jpg" and (tmp_path / "a.jpg").exists()
    moved = str(tmp_path / "moved")
    for _ in range(2):
        assert tuple(workspace.plan_counts(workspace.execute_plan(plan, "path", moved, copy=False)).first()) == (2, 0, 1)
    assert not (tmp_path / "a.jpg").exists() and os.listdir(f"{moved}/person_00") == ["a.jpg"]
    with pytest.raises(ValueError):
        workspace.execute_plan(plan.unionAll(plan), "path", moved, copy=False)


def test_alignment(spark):
    pixels = np.zeros((300, 300, 3))
    pixels[:, :, 0], pixels[:, :, 1] = np.arange(300)[None, :] * 0.8, np.arange(300)[:, None] * 0.8
    points = models.TEMPLATE * 1.5 + [40, 20]
    square = models.aligned(pixels, points.tolist())
    y, x = np.mgrid[:112, :112]
    assert np.allclose(square[:, :, 0], 0.8 * (1.5 * x + 40)) and np.allclose(square[:, :, 1], 0.8 * (1.5 * y + 20))
    near = (models.TEMPLATE * 0.5).tolist()
    line = [[30.0 * i, 10.0] for i in range(5)]
    assert [models.aligned(pixels, p) for p in (None, points[:4].tolist(), near, line)] == [None] * 4
    data = np.rint(pixels[:, :, ::-1]).astype(np.uint8).tobytes()
    rows = [("a", (300, 300, 3, data), points.tolist()), ("b", (300, 300, 3, data), None), ("c", None, points.tolist())]
    got = {r.path: r for r in models.align(spark.createDataFrame(rows, f"path string, image {IMAGE}, landmarks array<array<double>>")).collect()}
    made = np.frombuffer(got["a"].aligned.data, np.uint8).reshape(112, 112, 3)[:, :, ::-1]
    assert np.abs(made - square).max() <= 1.0 and got["a"].error is None
    assert got["b"].aligned is None and got["b"].error is None and got["c"].error == "image can't be decoded"


def test_blocks_of_labels(spark):
    rows = spark.createDataFrame([([0.1, 0.5, 0.5, 0.05, 0.9, 7.0],), ([0.2, 0.3],), (None,)], "p array<double>")
    got = rows.select(block_results(F.col("p"), {"scene": ["x", "y", "z"], "style": ["s", "t"]}).alias("r")).collect()
    assert [(b.category, b.tag, b.scores) for b in got[0].r] == [("scene", "y", {"y": 0.5, "z": 0.5}), ("style", "t", {"t": 0.9})]
    assert [(b.tag, b.scores) for r in got[1:] for b in r.r] == [(None, None)] * 4
