"""One chain for an image's faces, with a plug-in encoder."""

import numpy as np
import pytest
from facetlake.functions import pixels, quality
from facetlake.operators import models
from facetlake.operators.face_chain import _point, embedded_faces, face_records
from pyspark.sql import functions as F

SCHEMA = f"path string, mark long, image {models.IMAGE}, faces array<{models.FACE}>, error string"


def _load():
    def model(rgb, box):
        if box["left"] == 13:
            raise RuntimeError("no")
        if box["left"] == 14:
            return None
        return [rgb.mean(), rgb.shape[0], box["right"] - box["left"]]

    return model


def _image(seed, high=300, wide=320):
    data = np.random.default_rng(seed).integers(0, 256, (high, wide, 3), np.uint8)
    return (high, wide, 3, data.tobytes())


def _box(left, top=10, side=60):
    return {"top": top, "right": left + side, "bottom": top + side, "left": left}


MARKS = (models.TEMPLATE * 1.5 + [40, 20]).tolist()


@pytest.fixture(scope="module")
def images(spark):
    flat = (300, 320, 3, bytes([90]) * 288_000)
    rows = [
        ("a", 1, _image(1), [(_box(20), 0.9, MARKS), (_box(30), 0.8, None), (_box(13), 0.8, None), (_box(14), 0.8, None), (None, 0.5, None), (_box(900), 0.7, None), (_box(40), 0.6, [[1.0, None], None])], None),
        ("flat", 2, flat, [(_box(20), 0.9, None)], None),
        ("broken", 3, (5, 5, 3, b"x"), [(_box(20), 0.9, None)], None),
        ("failed", 4, _image(2), [(_box(20), 0.9, None)], "not read"),
        ("none", 5, _image(3), [], None),
        ("null", 6, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_each_face_has_its_vector_or_the_step_that_ended_it(spark, images):
    got = {r.path: r for r in face_records(images, _load, 0.2).collect()}
    assert got["a"].mark == 1 and "faces" not in got["a"] and "image" not in got["a"]
    assert [got[p].error for p in ("a", "flat", "broken", "failed", "none", "null")] == [None, None, "image can't be decoded", "not read", None, None]
    assert got["broken"].records is None and [got[p].records for p in ("failed", "none", "null")] == [[]] * 3
    faces = got["a"].records
    assert [f.face_index for f in faces] == list(range(7))
    assert [f.error for f in faces] == [None, None, "encode: RuntimeError: no", "encode: no vector", "box: none", "quality: too low", None]
    assert [f.aligned for f in faces] == [True, False, False, False, None, None, False]
    rgb = pixels.decoded(*_image(1))
    square = models.aligned(rgb, MARKS)
    assert np.allclose(faces[0].embedding, [square.mean(), 112, 112]) and np.allclose(faces[1].embedding, [rgb.mean(), 300, 60])
    assert np.allclose(faces[0].head, pixels.head_features(rgb, **_box(20))) and faces[2].head is None
    # Grey without edges and without landmarks has the landmarks' share only and its size's.
    assert got["flat"].records[0].error is None and abs(got["flat"].records[0].quality - (0.6 * 0.3 * (3600 / 96_000 / 0.05) + 0.16)) < 1e-9


def test_quality_is_that_of_the_columns(spark, images):
    got = face_records(images, _load).select("path", F.explode("records").alias("r")).select("path", "r.*").where("quality IS NOT NULL")
    flat = images.where("error IS NULL").select("path", "image", F.posexplode("faces").alias("face_index", "face")).select("path", "face_index", "image", "face.*").where("box IS NOT NULL")
    measured = pixels.face_pixels(flat, ["path", "face_index"]).where("sharpness IS NOT NULL")
    points = quality.landmark_quality(*[_point(F.col("landmarks"), i) for i in range(5)])
    want = measured.join(flat.drop("image"), ["path", "face_index"]).select(
        "path", "face_index", quality.combined_quality(quality.face_quality(F.col("sharpness"), F.col("size_ratio")), points).alias("want")
    )
    both = got.join(want, ["path", "face_index"], "full").select("quality", "want").collect()
    assert len(both) == 7 and all(abs(r.quality - r.want) < 1e-9 for r in both)


def test_scaled_images_keep_the_boxes_they_were_given(spark, images):
    face = face_records(images.where("path = 'a'"), _load, longest=160).first().records[0]
    rgb = pixels.area_resampled(pixels.decoded(*_image(1)), 160, 150)
    square = models.aligned(rgb, [[x / 2, y / 2] for x, y in MARKS])
    assert face.box.left == 20 and face.landmarks == MARKS and np.allclose(face.embedding, [square.mean(), 112, 112])
    assert np.allclose(face.head, pixels.head_features(rgb, top=5, right=40, bottom=35, left=10))


@pytest.mark.parametrize("few", [0, 1000])
def test_only_images_that_the_cache_lacks_are_decoded(spark, images, few):
    first = embedded_faces(images, images.sparkSession.createDataFrame([], f"path string, mark long, {_fields()}"), ["path", "mark"], _load, few=few)
    rows = sorted((r.path, r.face_index, r.cached) for r in first.collect())
    assert rows == [("a", i, False) for i in (0, 1, 5, 6)] + [("flat", 0, False)]
    cache = first.drop("cached").where("path = 'a'")
    stale = cache.withColumn("mark", F.lit(77).cast("long"))

    def broken():
        def model(rgb, box):
            if rgb.std() > 1:  # image a
                raise RuntimeError("decoded again")
            return [1.0]

        return model

    again = {(r.path, r.face_index): r for r in embedded_faces(images, cache.unionByName(stale), ["path", "mark"], broken, few=few).collect()}
    assert sorted((*k, r.cached) for k, r in again.items()) == [("a", i, True) for i in (0, 1, 5, 6)] + [("flat", 0, False)]
    assert again["a", 1].embedding == next(r.embedding for r in first.collect() if r.path == "a" and r.face_index == 1) and again["flat", 0].embedding == [1.0]
    assert embedded_faces(images.limit(0), cache, ["path", "mark"], _load, few=few).count() == 0


def _fields():
    from facetlake.operators.face_chain import RECORD

    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in models.StructType.fromDDL(f"r {RECORD}")["r"].dataType.fields)
