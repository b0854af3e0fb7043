import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.functions import shared_space as space

SCHEMA = "path string, image struct<height:int,width:int,nChannels:int,data:binary>"


def image(rgb):
    bgr = np.asarray(rgb, np.uint8)[:, :, ::-1]
    return (*bgr.shape[:2], 3, bgr.tobytes())


def plainly(rgb):
    """The same numbers, pixel by pixel and patch by patch."""
    height, width = len(rgb), len(rgb[0])
    mean = lambda x: sum(x) / len(x) if x else 0.0
    grey = [[sum(p) / 3 for p in row] for row in rgb]
    every = [x for row in grey for x in row]
    out = [sum(64 * b <= p[c] < 64 * b + 64 for row in rgb for p in row) / (height * width) for c in range(3) for b in range(4)]
    out += [mean(every), mean([(x - mean(every)) ** 2 for x in every]) ** 0.5, np.percentile(every, 10), np.percentile(every, 90), width / height]
    out.append(mean([(max(p) - min(p)) / max(p) if max(p) else 0.0 for row in rgb for p in row]))
    out.append(mean([abs(a - b) for row in grey for a, b in zip(row, row[1:])]) + mean([abs(a - b) for r, s in zip(grey, grey[1:]) for a, b in zip(r, s)]))
    out += [mean([p[c] for row in rgb for p in row]) / max(mean(every), 1) for c in range(3)]
    flat = lambda rows: mean([x for row in rows for x in row])
    out += [flat(grey[: height // 2]), flat(grey[height // 2 :]), flat([r[: width // 2] for r in grey]), flat([r[width // 2 :] for r in grey])]
    side, patches = max(height // 8, 1), []
    for i in range(0, height - side, side):
        for j in range(0, width - side, side):
            patch = [x for row in grey[i : i + side] for x in row[j : j + side]]
            patches.append(mean([(x - mean(patch)) ** 2 for x in patch]))
    out = np.array(out + [mean(patches)] + [0.0] * 37)
    return out / (np.linalg.norm(out) or 1)


def test_image_numbers(spark):
    rng = np.random.default_rng(3)
    made = [rng.integers(0, 256, size) for size in ((40, 30, 3), (9, 25, 3), (1, 1, 3), (1, 7, 3), (16, 2, 3), (17, 17, 3))] + [np.zeros((5, 5, 3)), np.full((20, 20, 3), 255)]
    rows = [(str(i), image(x)) for i, x in enumerate(made)] + [("bad", (-1, -1, -1, None)), ("none", None)]
    got = {r.path: r.vector for r in space.image_vectors(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    for i, x in enumerate(made):
        assert got[str(i)] == pytest.approx(plainly(x.astype(int).tolist()), abs=1e-6), i
    assert got["bad"] is None and got["none"] is None and len(got) == len(rows)
    assert space.image_vectors(spark.createDataFrame([], SCHEMA), "path").count() == 0


def test_text_numbers(spark):
    texts = ["Snow at NIGHT", "portrait\tof a friend", "personal", "faces", "", None, "x " * 200_000 + "vivid", "sunset sunset"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", space.text_vector(F.col("t")).alias("v")).orderBy("i").collect()
    v = [None if r.v is None else np.array(r.v) for r in rows]
    raw = np.zeros(64)
    raw[[0, 4, 8]] = 0.21 + 0.03, 0.21 + 0.03, 0.21 + 0.045
    assert v[0] == pytest.approx(raw / np.linalg.norm(raw))  # dark and bright at once meet at nothing
    raw = np.zeros(64)
    raw[:12], raw[16] = 0.05, 0.3
    assert v[1] == pytest.approx(raw / np.linalg.norm(raw))
    assert v[2][16] == pytest.approx(1) and not v[3].any() and not v[4].any() and v[5] is None
    assert v[6][17] == pytest.approx(1) and v[7] == pytest.approx(np.array([8, 0, 0, 0, 3, 0, 0, 0, 1] + [0] * 55) / 74**0.5)


def test_images_are_ranked_for_a_text(spark):
    red, dark = np.zeros((8, 8, 3)), np.zeros((8, 8, 3))
    red[..., 0] = 60
    vectors = space.image_vectors(spark.createDataFrame([("b", image(red)), ("a", image(red)), ("c", image(dark)), ("d", (-1, -1, -1, None))], SCHEMA), "path")
    got = [(r.path, r.score) for r in space.images_for_text(vectors, "path", "a bright sunset", k=2, least=0.0).collect()]
    every = {r.path: r.score for r in space.images_for_text(vectors, "path", "a bright sunset", least=-1.0).collect()}
    assert [p for p, _ in got] == sorted(every, key=lambda p: (-every[p], p))[:2] and set(every) == {"a", "b", "c"} and every["a"] == every["b"]
    text = spark.range(1).select(space.text_vector(F.lit("a bright sunset")).alias("v")).first().v
    assert every["c"] == pytest.approx(float(np.dot(text, space.image_vector(dark))), abs=1e-6)
    short = spark.createDataFrame([("s", [1.0]), ("n", None)], "path string, vector array<double>")
    assert space.images_for_text(short, "path", "sunset").count() == 0 and space.images_for_text(vectors, "path", "nothing").count() == 0
