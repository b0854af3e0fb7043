"""Where detectors and encoders of the caller's plug in: functions over decoded images, loaded once in each task.

A detector takes an RGB array and returns (box, confidence, landmarks) for each face;
an encoder takes an RGB array and a box and returns a vector, or None. ``load`` makes
one of them inside the task, so that models are not shipped with the plan. An image
that can't be decoded, and a model that fails on one, give a row with ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from facetlake.functions.pixels import decoded

BOX = "struct<top:int,right:int,bottom:int,left:int>"
FACE = f"struct<box:{BOX},confidence:double,landmarks:array<array<double>>>"

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"

#: Where the left and right eye, the nose and the corners of the mouth go in a square of 112 pixels.
TEMPLATE = np.array([[38.0, 42.0], [74.0, 42.0], [56.0, 62.0], [38.0, 74.0], [74.0, 74.0]])
TEMPLATE_SIZE = 112
#: Fixed value: eyes nearer than this many pixels are not aligned.
EYES_APART = 20.0

Detector = Callable[[np.ndarray], list[tuple[dict, float, list | None]]]
Encoder = Callable[[np.ndarray, dict], np.ndarray | None]


def _each(rows: DataFrame, load: Callable[[], Callable], call: Callable, key: str, kind: str) -> DataFrame:
    """(row columns, key, error): ``call(model, pixels, row)`` for each image row, in the order of the rows of a task."""
    schema = StructType([*rows.drop("image").schema.fields, *StructType.fromDDL(f"{key} {kind}, error string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for lo in range(0, len(batch), 16):  # few decoded images at a time
                made = []
                for row in batch.slice(lo, 16).to_pylist():
                    image = row.pop("image") or {}
                    pixels = decoded(image.get("height"), image.get("width"), image.get("nChannels"), image.get("data"))
                    row |= {key: None, "error": None if pixels is not None else "image can't be decoded"}
                    if pixels is not None:
                        try:
                            row[key] = call(model, pixels, row)
                        except Exception as problem:  # a model is the caller's code: one image must not end the job
                            row["error"] = f"{type(problem).__name__}: {problem}"
                    made.append(row)
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.mapInArrow(run, schema)


def detect(images: DataFrame, load: Callable[[], Detector], min_confidence: float = 0.5, min_size: int = 40) -> DataFrame:
    """Images with ``faces`` (sure and large enough ones, in the model's order) and ``error``, without their pixels."""

    def call(model: Detector, pixels: np.ndarray, row: dict) -> list[dict]:
        found = [{"box": b, "confidence": float(c), "landmarks": m} for b, c, m in model(pixels)]
        large = lambda b: min(b["right"] - b["left"], b["bottom"] - b["top"]) >= min_size
        return [f for f in found if f["confidence"] >= min_confidence and large(f["box"])]

    return _each(images, load, call, "faces", f"array<{FACE}>")


def encode(faces: DataFrame, load: Callable[[], Encoder], box: str = "box") -> DataFrame:
    """Faces (a row for each, with ``image``) with ``embedding`` and ``error``; null where the model gives none."""

    def call(model: Encoder, pixels: np.ndarray, row: dict) -> list[float] | None:
        vector = model(pixels, row[box])
        return None if vector is None else np.asarray(vector, np.float64).tolist()

    return _each(faces, load, call, "embedding", "array<double>")


def aligned(pixels: np.ndarray, landmarks: list | None, size: int = TEMPLATE_SIZE) -> np.ndarray | None:
    """A square in which the five landmarks lie on the template, by the affine map that fits them best.

    None without five landmarks, with eyes too near each other, or with landmarks on one line. Places between pixels
    are interpolated; what lies outside the image is black.
    """
    points = np.array(landmarks or [], np.float64)
    if points.shape != TEMPLATE.shape or np.hypot(*(points[1] - points[0])) < EYES_APART or np.linalg.matrix_rank(points - points.mean(0)) < 2:
        return None
    target = TEMPLATE * (size / TEMPLATE_SIZE)
    back = np.linalg.lstsq(np.c_[target, np.ones(5)], points, rcond=None)[0]  # from the square to the image
    y, x = np.mgrid[:size, :size]
    at = np.c_[x.ravel(), y.ravel(), np.ones(size * size)] @ back
    low = np.floor(at).astype(np.int64)
    share = at - low
    out = np.zeros((size * size, 3))
    for dx in (0, 1):
        for dy in (0, 1):
            px, py = low[:, 0] + dx, low[:, 1] + dy
            inside = (px >= 0) & (py >= 0) & (px < pixels.shape[1]) & (py < pixels.shape[0])
            weight = np.abs(1 - dx - share[:, 0]) * np.abs(1 - dy - share[:, 1])
            out[inside] += weight[inside, None] * pixels[py[inside], px[inside]]
    return out.reshape(size, size, 3)


def align(faces: DataFrame, landmarks: str = "landmarks", size: int = TEMPLATE_SIZE) -> DataFrame:
    """Faces with ``aligned``, an image like those of the source, null where a face can't be aligned; and ``error``."""

    def call(model: None, pixels: np.ndarray, row: dict) -> dict | None:
        square = aligned(pixels, row[landmarks], size)
        if square is None:
            return None
        data = np.rint(square[:, :, ::-1]).astype(np.uint8).tobytes()
        return {"height": size, "width": size, "nChannels": 3, "data": data}

    return _each(faces, lambda: None, call, "aligned", IMAGE)


def encode_missing(faces: DataFrame, cache: DataFrame, keys: list[str], load: Callable[[], Encoder], box: str = "box") -> DataFrame:
    """Faces with vectors from ``cache`` where path, fingerprint and settings (``keys``) agree; only the others are encoded."""
    known = cache.dropDuplicates(keys).select(*keys, "embedding")
    hits = faces.drop("image").join(known, keys).withColumn("error", F.lit(None).cast("string"))
    return hits.unionByName(encode(faces.join(known, keys, "left_anti"), load, box))
