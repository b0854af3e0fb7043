"""From an image's boxes to vectors in one pass: quality, filter, alignment, encoding and head features of each face."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.pixels import GREY, area_resampled, fitted, head_features, sharpness
from facetlake.functions.quality import landmark_quality

from .models import BOX, FACE, TEMPLATE_SIZE, Encoder, _each, aligned

RECORD = (
    f"struct<face_index:int,box:{BOX},confidence:double,landmarks:array<array<double>>,quality:double,aligned:boolean,"
    "embedding:array<double>,head:array<double>,error:string>"
)
#: What is known of a face before its image is decoded.
GIVEN = f"struct<face:{FACE},points:double>"


def _point(landmarks: Column, i: int) -> Column:
    """A landmark as (x, y), null where it or one of its two numbers is missing."""
    x, y = F.get(F.get(landmarks, F.lit(i)), F.lit(0)), F.get(F.get(landmarks, F.lit(i)), F.lit(1))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def _given(faces: Column) -> Column:
    """The faces with the quality of their landmarks, as an expression."""
    return F.transform(faces, lambda f: F.struct(f.alias("face"), landmark_quality(*[_point(f["landmarks"], i) for i in range(5)]).alias("points"))).cast(f"array<{GIVEN}>")


def pixel_quality(pixels: np.ndarray, box: dict) -> float:
    """The quality of a face's pixels as ``quality.face_quality`` has it; a box outside the image has 0."""
    high, wide = pixels.shape[:2]
    y1, y2, x1, x2 = max(0, box["top"]), min(high, box["bottom"]), max(0, box["left"]), min(wide, box["right"])
    if y2 <= y1 or x2 <= x1:
        return 0.0
    share = (y2 - y1) * (x2 - x1) / (high * wide)
    return 0.7 * min(1.0, sharpness(pixels[y1:y2, x1:x2] @ GREY) / 200) + (0.3 * min(1.0, share / 0.05) if share > 0.001 else 0.0)


def _record(model: Encoder, pixels: np.ndarray, given: dict, scale: tuple[float, float], min_quality: float, index: int) -> dict:
    """One face; a step that fails leaves the later ones out and is named in ``error``."""
    face = given["face"] or {}
    out = {"face_index": index, "box": face.get("box"), "confidence": face.get("confidence"), "landmarks": face.get("landmarks")}
    out |= {"quality": None, "aligned": None, "embedding": None, "head": None, "error": None}
    if out["box"] is None or None in out["box"].values():
        return out | {"error": "box: none"}
    sx, sy = scale
    box = {side: int(v * (sx if side in ("left", "right") else sy)) for side, v in out["box"].items()}
    step = "quality"
    try:
        out["quality"] = min(1.0, max(0.0, 0.6 * pixel_quality(pixels, box) + 0.4 * given["points"]))
        if min_quality > 0 and out["quality"] < min_quality:
            return out | {"error": "quality: too low"}
        step = "align"
        marks = out["landmarks"]
        square = aligned(pixels, [[p[0] * sx, p[1] * sy] for p in marks] if marks and all(p and len(p) == 2 and None not in p for p in marks) else None)
        out["aligned"] = square is not None
        step = "encode"
        whole = {"top": 0, "right": TEMPLATE_SIZE, "bottom": TEMPLATE_SIZE, "left": 0}
        vector = model(pixels, box) if square is None else model(square, whole)
        if vector is None:
            return out | {"error": "encode: no vector"}
        out["embedding"] = np.asarray(vector, np.float64).tolist()
        step = "head"
        out["head"] = head_features(pixels, **box).tolist()
    except Exception as problem:  # a model is the caller's code: one face must not end the job
        out["error"] = f"{step}: {type(problem).__name__}: {problem}"
    return out


def face_records(images: DataFrame, load: Callable[[], Encoder], min_quality: float = 0.0, longest: int = 0) -> DataFrame:
    """Images with ``records`` in the place of ``image`` and ``faces``, and with ``error``.

    ``images`` has ``image`` (a row of Spark's source), ``faces`` (as ``models.detect`` makes them) and perhaps ``error``.
    Each image is decoded once. A face that can be aligned is encoded as the aligned square, another one as its box in
    the image. ``longest`` scales larger images down; boxes and landmarks are those of the image as it is given, before
    and after. Images without faces, and those with an ``error`` already, never reach Python; their records are empty.
    An image that can't be decoded has ``error`` and null records. A face keeps its row in any case: without a vector
    its ``error`` names the step that ended it.
    """
    known = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    rows = images.withColumns({"_known": known, "_given": _given(F.col("faces"))}).drop("error", "faces")

    def call(model: Encoder, pixels: np.ndarray, row: dict) -> list[dict]:
        high, wide = pixels.shape[:2]
        width, height = fitted(wide, high, longest)
        small = pixels if (width, height) == (wide, high) else area_resampled(pixels, width, height)
        return [_record(model, small, g, (width / wide, height / high), min_quality, i) for i, g in enumerate(row["_given"])]

    wanted = F.col("_known").isNull() & (F.coalesce(F.size("_given"), F.lit(-1)) > 0)
    done = _each(rows.where(wanted), load, call, "records", f"array<{RECORD}>").drop("_given", "_known")
    rest = rows.where(~wanted).select("*", F.array().cast(f"array<{RECORD}>").alias("records"), F.col("_known").alias("error"))
    return done.unionByName(rest.select(*done.columns))


def embedded_faces(
    images: DataFrame, cache: DataFrame, keys: list[str], load: Callable[[], Encoder], min_quality: float = 0.0, longest: int = 0, few: int = 1_000_000
) -> DataFrame:
    """(keys, the fields of a record, ``cached``): the faces with a vector, from ``cache`` or made anew.

    ``cache`` has a row for each face: ``keys`` (path, fingerprint, settings) and the fields of a record. An image whose
    keys are there isn't decoded; null keys never agree. Only the cache's keys meet the images: up to ``few`` of them go
    to the images, more are joined by a shuffle. Faces without a vector are left out; see ``face_records`` for their errors.
    """
    fields = ["face_index", "box", "confidence", "landmarks", "quality", "aligned", "embedding", "head", "error"]
    known = cache.select(*keys).distinct()
    known = F.broadcast(known) if known.limit(few + 1).count() <= few else known
    made = face_records(images.join(known, keys, "left_anti"), load, min_quality, longest)
    made = made.select(*keys, F.explode("records").alias("r")).select(*keys, "r.*").where(F.col("embedding").isNotNull())
    hits = cache.join(images.select(*keys).distinct(), keys, "left_semi").where(F.col("embedding").isNotNull())
    return made.select(*keys, *fields, F.lit(False).alias("cached")).unionByName(hits.select(*keys, *fields, F.lit(True).alias("cached")))
