import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.functions import boxes, pixels

SCHEMA = "path string, image struct<height:int,width:int,nChannels:int,data:binary>, box struct<top:int,right:int,bottom:int,left:int>"


def image(rgb, box=(0, 10, 10, 0)):
    bgr = np.asarray(rgb, np.uint8)[:, :, ::-1]
    return (*bgr.shape[:2], 3, bgr.tobytes()), box


def frame(spark, images):
    return spark.createDataFrame([(str(i), im, box) for i, (im, box) in enumerate(images)], SCHEMA)


def test_scene_and_style(spark):
    dark, grey = np.full((20, 20, 3), 30), np.full((20, 40, 3), 128)
    blue = np.zeros((40, 20, 3)) + [60, 100, 250]
    green = np.zeros((20, 20, 3)) + [40, 200, 40]
    df = frame(spark, [image(dark), image(grey), image(blue), image(green), ((-1, -1, -1, None), None)])
    rows = pixels.image_stats(df, "path").select("path", pixels.scene_scores().alias("scene"), pixels.style_scores().alias("style")).orderBy("path").collect()
    assert set(rows[0].scene) == {"night"} and rows[0].scene["night"] == pytest.approx(50 / 80)
    assert set(rows[1].scene) == {"indoor"} and {"bw", "landscape"} == set(rows[1].style)
    assert "sky" in rows[2].scene and "portrait" in rows[2].style
    assert "forest" in rows[3].scene and "square" in rows[3].style
    assert len(rows) == 5 and set(rows[4].scene) == {"general"}
    assert pixels.image_stats(df.limit(0), "path").count() == 0


def test_hue_like_colorsys():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, 7, 3)).astype(float)
    h, s, v = pixels.hue_saturation_value(x)
    for i in range(6):
        for j in range(7):
            want = colorsys.rgb_to_hsv(*(x[i, j] / 255))
            assert np.allclose((h[i, j] / 360, s[i, j], v[i, j]), want)


def test_face_pixels(spark):
    rng = np.random.default_rng(1)
    noisy, flat = rng.integers(0, 256, (60, 60, 3)), np.full((60, 60, 3), 90)
    df = frame(spark, [image(noisy, (10, 40, 40, 10)), image(flat, (10, 40, 40, 10)), image(flat, (70, 90, 90, 70)), ((-1, -1, -1, None), (1, 2, 3, 0))])
    rows = pixels.face_pixels(df, ["path"]).orderBy("path").collect()
    assert rows[0].sharpness > 200 and rows[1].sharpness == pytest.approx(0, abs=1e-9)
    assert rows[0].size_ratio == pytest.approx(0.25) and len(rows[0].head) == 28
    assert sum(rows[0].head[:16]) == pytest.approx(1) and rows[1].head[-1] == pytest.approx(0, abs=1e-9)
    assert (rows[2].sharpness, rows[2].size_ratio) == (0.0, 0.0)
    assert rows[3].sharpness is None and rows[3].head is None
    grey = rng.normal(size=(5, 6))
    p = np.pad(grey, 1, mode="edge")
    want = [[p[i, j + 1] + p[i + 2, j + 1] + p[i + 1, j] + p[i + 1, j + 2] - 4 * p[i + 1, j + 1] for j in range(6)] for i in range(5)]
    assert pixels.sharpness(grey) == pytest.approx(np.var(want))


def test_landmarks(spark):
    pts = lambda *xy: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])
    five = boxes.five_landmarks(pts((0.2, 0.8), (0.4, 0.8)), pts((0.6, 0.8)), pts((0.5, 0.6), (0.5, 0.5)), pts((0.3, 0.3), (0.7, 0.2), (0.5, 0.1)), F.lit(100), F.lit(200))
    none = boxes.five_landmarks(F.slice(pts((0, 0)), 1, 0), pts((0, 0)), pts((0, 0)), pts((0, 0)), F.lit(1), F.lit(1))
    got = spark.range(1).select(five.alias("a"), none.alias("b")).first()
    flat = [v for p in got.a for v in (p["x"], p["y"])]
    assert flat == pytest.approx([30, 40, 60, 40, 50, 100, 30, 140, 70, 160]) and got.b is None
    line = boxes.median_box(F.array(F.lit(50.0), F.lit(50.0)), F.array(F.lit(20.0), F.lit(60.0)), F.lit(20.0), F.lit(100), F.lit(100))
    assert tuple(spark.range(1).select(line.alias("b")).first().b) == (2, 83, 64, 17)
    s = "image string, rect_id int, x double, y double, w double, h double"
    rects = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.2, 0.2), ("a", 2, 0.5, 0.5, 0.2, 0.2)], s)
    marks = spark.createDataFrame([("a", 7, 0.01, 0.0, 0.2, 0.2), ("a", 8, 0.04, 0.0, 0.2, 0.2), ("b", 9, 0.5, 0.5, 0.2, 0.2)], s.replace("rect_id", "mark_id"))
    assert {r.rect_id: r.mark_id for r in boxes.nearest_landmarks(rects, marks, "image").collect()} == {1: 7, 2: None}
