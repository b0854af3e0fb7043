"""Box columns: struct<top, right, bottom, left> of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    return F.struct(top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"), left.cast("int").alias("left"))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; boxes that only touch give 0."""
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    shared = w * h
    union = area(a) + area(b) - shared
    return F.when((w > 0) & (h > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def large_enough(b: Column, least: int = 40) -> Column:
    """Neither side below ``least``."""
    return (width(b) >= least) & (height(b) >= least)


def shrunk_body(b: Column, ratio: float = 1.8) -> Column:
    """A box taller than ``ratio`` widths is a body: its head is kept, from the same top."""
    h = F.greatest(F.floor(width(b) * 1.25), F.floor(height(b) * 0.5))
    tall = (width(b) > 0) & (height(b) / width(b) > ratio)
    return box(b["top"], b["right"], F.when(tall, b["top"] + h).otherwise(b["bottom"]), b["left"])


def pixels_from_unit(x: Column, y: Column, w: Column, h: Column, image_width: Column, image_height: Column) -> Column:
    """A box in units of the image with its origin at the lower left, in pixels from the upper left."""
    return box(F.floor((1 - y - h) * image_height), F.floor((x + w) * image_width), F.floor((1 - y) * image_height), F.floor(x * image_width))


def contour_box(xs: Column, ys: Column, image_width: Column, image_height: Column) -> Column:
    """Around points: a fifth more on each side, 45 % above, 10 % below, within the image."""
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    zero = F.lit(0)
    return box(
        F.greatest(zero, F.floor(F.array_min(ys) - h * 0.45)),
        F.least(image_width, F.floor(F.array_max(xs) + w * 0.2)),
        F.least(image_height, F.floor(F.array_max(ys) + h * 0.1)),
        F.greatest(zero, F.floor(F.array_min(xs) - w * 0.2)),
    )


def suppressed(detections: Column, threshold: float = 0.5) -> Column:
    """Non-maximum suppression of array<struct<confidence, pos, box>>.

    From the most confident on (ties: the smaller ``pos``) a detection stays if no
    one that stays overlaps it by ``threshold`` or more. The fold runs inside one
    image's row, so images are independent.
    """
    order = F.array_sort(
        detections,
        lambda a, b: F.when(a["confidence"] > b["confidence"], -1)
        .when(a["confidence"] < b["confidence"], 1)
        .when(a["pos"] < b["pos"], -1)
        .when(a["pos"] > b["pos"], 1)
        .otherwise(0),
    )
    return F.aggregate(
        order,
        F.slice(order, 1, 0),
        lambda kept, d: F.when(F.exists(kept, lambda k: iou(k["box"], d["box"]) >= threshold), kept).otherwise(F.concat(kept, F.array(d))),
    )


def primary_faces(faces: DataFrame, image: str, index: str, b: Column, confidence: Column, image_width: Column, image_height: Column) -> DataFrame:
    """Adds ``primary_score`` and ``is_primary``, one true row for each image.

    Half the share of the image's area, .3 the closeness to its centre, .2 the
    confidence; the first of equals by ``index`` wins. An image without area has its
    first face as the primary one.
    """
    cx, cy = (b["left"] + b["right"]) / 2 - image_width / 2, (b["top"] + b["bottom"]) / 2 - image_height / 2
    reach = F.sqrt(image_width * image_width + image_height * image_height) / 2
    size = image_width * image_height
    score = F.when(
        size > 0, 0.5 * area(b) / size + 0.3 * (1 - F.least(F.sqrt(cx * cx + cy * cy) / reach, F.lit(1.0))) + 0.2 * confidence
    ).otherwise(0.0)
    order = Window.partitionBy(image).orderBy(F.desc("primary_score"), index)
    return faces.withColumn("primary_score", score).withColumn("is_primary", F.row_number().over(order) == 1)


def median_box(xs: Column, ys: Column, eye_distance: Column, image_width: Column, image_height: Column) -> Column:
    """From the points of the middle line: two and a half eye distances wide, or as wide as high without eyes; padded like ``contour_box``."""
    h = F.array_max(ys) - F.array_min(ys)
    half = F.when(eye_distance.isNotNull(), F.floor(eye_distance * 2.5) / 2).otherwise(h * 0.5)
    middle = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    zero = F.lit(0)
    return box(
        F.greatest(zero, F.floor(F.array_min(ys) - h * 0.45)),
        F.least(image_width, F.floor(middle + half + h * 0.2)),
        F.least(image_height, F.floor(F.array_max(ys) + h * 0.1)),
        F.greatest(zero, F.floor(middle - half - h * 0.2)),
    )


def five_landmarks(left_eye: Column, right_eye: Column, nose: Column, lips: Column, image_width: Column, image_height: Column) -> Column:
    """Five points in pixels from regions of points (arrays of struct x, y from 0 to 1, origin at the lower left).

    Centres of the eyes, the lowest point of the nose, the outermost points of the
    lips; null if a region has no points.
    """
    place = lambda p: F.struct((p["x"] * image_width).alias("x"), ((1 - p["y"]) * image_height).alias("y"))

    def centre(points: Column) -> Column:
        mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(points)
        return place(F.struct(mean("x").alias("x"), mean("y").alias("y")))

    def first(points: Column, axis: str, sign: int) -> Column:
        keyed = F.transform(points, lambda p, i: F.struct((p[axis] * sign).alias("k"), i.alias("i"), p.alias("p")))
        return place(F.array_min(keyed)["p"])

    regions = [left_eye, right_eye, nose, lips]
    full = F.lit(True)
    for r in regions:
        full = full & F.coalesce(F.size(r) > 0, F.lit(False))
    return F.when(full, F.array(centre(left_eye), centre(right_eye), first(nose, "y", 1), first(lips, "x", 1), first(lips, "x", -1)))


def nearest_landmarks(rects: DataFrame, landmarks: DataFrame, image: str, reach: float = 0.05) -> DataFrame:
    """Each rectangle (image, rect_id, x, y, w, h) with the landmark observation of its image whose centre is nearest and nearer than ``reach``.

    The join is by image, whose observations are few; the first of equals by ``mark_id`` wins.
    """
    r = rects.select(image, "rect_id", (F.col("x") + F.col("w") / 2).alias("_rx"), (F.col("y") + F.col("h") / 2).alias("_ry"))
    m = landmarks.select(image, "mark_id", (F.col("x") + F.col("w") / 2).alias("_mx"), (F.col("y") + F.col("h") / 2).alias("_my"))
    far = F.sqrt((F.col("_rx") - F.col("_mx")) ** 2 + (F.col("_ry") - F.col("_my")) ** 2)
    near = r.join(m, image).withColumn("_d", far).where(F.col("_d") < reach)
    best = near.groupBy(image, "rect_id").agg(F.min(F.struct("_d", "mark_id")).alias("b")).select(image, "rect_id", F.col("b.mark_id").alias("mark_id"))
    return rects.join(best, [image, "rect_id"], "left")


def scaled(box: Column, across: Column, down: Column) -> Column:
    """A box (top, right, bottom, left) of an image whose sides were multiplied so, cut to whole pixels; null with a null scale."""
    along = lambda side, by: (box[side] * by).cast("int").alias(side)
    return F.when(across.isNotNull() & down.isNotNull(), F.struct(along("top", down), along("right", across), along("bottom", down), along("left", across)))
