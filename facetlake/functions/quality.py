"""Quality scores of faces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def landmark_quality(left_eye: Column, right_eye: Column, nose: Column, left_mouth: Column, right_mouth: Column) -> Column:
    """How level the eyes are (.4) and how far the mouth is from the nose (.6): 0 to 1.

    A missing point gives .4; eyes closer than a pixel, or points out of order from
    top to bottom, give .3.
    """
    eyes = F.sqrt((right_eye["x"] - left_eye["x"]) ** 2 + (right_eye["y"] - left_eye["y"]) ** 2)
    eye_y, mouth_y = (left_eye["y"] + right_eye["y"]) / 2, (left_mouth["y"] + right_mouth["y"]) / 2
    level = 1 - F.least(F.abs(left_eye["y"] - right_eye["y"]) / (eyes + 1e-6), F.lit(1.0))
    ratio = F.abs(mouth_y - nose["y"]) / (eyes + 1e-6)
    shape = F.when((ratio < 0.2) | (ratio > 2.0), 0.5).when(ratio.between(0.3, 1.5), 1.0).otherwise(0.7)
    missing = left_eye.isNull() | right_eye.isNull() | nose.isNull() | left_mouth.isNull() | right_mouth.isNull()
    ordered = (eye_y < nose["y"]) & (nose["y"] < mouth_y)
    return F.when(missing, 0.4).when((eyes < 1) | ~ordered, 0.3).otherwise(0.4 * level + 0.6 * shape)


def face_quality(sharpness: Column, size_ratio: Column) -> Column:
    """.7 of the Laplacian variance up to 200 and .3 of the share of the image up to a twentieth."""
    size = F.when(size_ratio > 0.001, F.least(F.lit(1.0), size_ratio / 0.05)).otherwise(0.0)
    return 0.7 * F.least(F.lit(1.0), sharpness / 200) + 0.3 * size


def combined_quality(face: Column, landmarks: Column) -> Column:
    return clip(0.6 * face + 0.4 * landmarks)


def cluster_quality(quality: Column, area: Column, image_area: Column) -> Column:
    """Quality .4, size .2 (a tenth of the image is full), sharpness .4 by the quality as its proxy; unknown quality counts .5."""
    known = F.coalesce(quality, F.lit(0.5))
    size = F.when(image_area > 0, F.least(F.lit(1.0), area / F.greatest(image_area * 0.1, F.lit(1.0)))).otherwise(0.5)
    return (0.4 * clip(known) + 0.2 * size + 0.4 * known) / 1.0
