"""Pixel features of images: numpy inside Arrow batches, rules on top as columns.

Images come as rows of Spark's ``image`` source (``image.height``, ``image.width``,
``image.nChannels``, ``image.data`` in BGR order). An image that cannot be decoded
gives nulls, not an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREY = np.array([0.299, 0.587, 0.114])
HUES, SATURATIONS = 16, 8
STATS = ["mean_r", "mean_g", "mean_b", "mean_max", "mean_chroma"]


def decoded(height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray | None:
    """An RGB array of doubles, or None; one channel is grey, a fourth is dropped."""
    if not data or not height or not width or height < 1 or width < 1 or channels not in (1, 3, 4):
        return None
    pixels = np.frombuffer(data, np.uint8)
    if len(pixels) != height * width * channels:
        return None
    pixels = pixels.reshape(height, width, channels).astype(np.float64)
    return np.repeat(pixels, 3, 2) if channels == 1 else pixels[:, :, 2::-1]


def fitted(width: int, height: int, longest: int) -> tuple[int, int]:
    """The size at which no side is above ``longest``, cut to whole pixels; 0 or less sets no limit."""
    most = max(width, height)
    if longest <= 0 or most <= longest:
        return width, height
    ratio = longest / most
    return max(1, int(width * ratio)), max(1, int(height * ratio))


def area_resampled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers; sums run along one side and then along the other."""

    def along(x: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        edges = np.arange(size + 1) * (len(x) / size)
        low = np.minimum(edges.astype(np.int64), len(x) - 1)
        part = (edges - low).reshape(-1, *[1] * (x.ndim - 1))
        at = total[low] * (1 - part) + total[low + 1] * part
        return np.diff(at, axis=0) * (size / len(x))

    return along(along(pixels, height).swapaxes(0, 1), width).swapaxes(0, 1)


def scaled_images(images: DataFrame, key: str, longest: int) -> DataFrame:
    """(key, image, scale_x, scale_y): images (rows of Spark's source) whose longest side is at most ``longest``.

    Three channels in BGR order, whole numbers from 0 to 255; smaller images keep their size. ``scale_x`` and ``scale_y``
    take boxes along (``boxes.scaled``). An image that cannot be decoded is null, and so are its scales.
    """
    shape = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                h, w, c, data = (batch.column(k)[i].as_py() for k in range(1, 5))
                rgb, out, sides = decoded(h, w, c, data), None, (None, None)
                if rgb is not None:
                    width, height = fitted(w, h, longest)
                    small = rgb if (width, height) == (w, h) else area_resampled(rgb, width, height)
                    raw = np.clip(np.rint(small[:, :, ::-1]), 0, 255).astype(np.uint8).tobytes()
                    out, sides = {"height": height, "width": width, "nChannels": 3, "data": raw}, (width / w, height / h)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([out], shape), *(pa.array([s], pa.float64()) for s in sides)], names=[key, "image", "scale_x", "scale_y"])

    kind = images.schema[key].dataType.simpleString()
    parts = images.select(key, "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInArrow(run, f"`{key}` {kind}, image struct<height:int,width:int,nChannels:int,data:binary>, scale_x double, scale_y double")


def sharpness(grey: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; the border repeats."""
    p = np.pad(grey, 1, mode="edge")
    around = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    return float(np.var(around - 4 * grey))


def hue_saturation_value(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value from 0 to 1; grey pixels have hue 0."""
    x = rgb / 255
    top, spread = x.max(2), np.ptp(x, axis=2)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    safe = np.where(spread > 0, spread, 1)
    # Where channels tie for the largest, the last of red, green, blue decides.
    hue = np.select([top == b, top == g], [(r - g) / safe + 4, (b - r) / safe + 2], ((g - b) / safe) % 6)
    return np.where(spread > 0, hue * 60, 0), np.where(top > 0, spread / np.maximum(top, 1e-10), 0), top


def shares(values: np.ndarray, bins: int, high: float) -> np.ndarray:
    counts = np.histogram(values, bins, (0, high))[0]
    return counts / max(counts.sum(), 1)


def head_features(rgb: np.ndarray, top: int, right: int, bottom: int, left: int, expand: float = 2.0) -> np.ndarray:
    """28 numbers of the head: hue and saturation shares and means of the hair, edge density of the whole crop."""
    grow_x, grow_y = (right - left) * (expand - 1), (bottom - top) * (expand - 1)
    y1, y2 = max(0, top - int(grow_y * 0.7)), min(rgb.shape[0], bottom + int(grow_y * 0.3))
    x1, x2 = max(0, left - int(grow_x / 2)), min(rgb.shape[1], right + int(grow_x / 2))
    out = np.zeros(HUES + SATURATIONS + 4)
    if x2 <= x1 or y2 <= y1:
        return out
    crop = rgb[y1:y2, x1:x2]
    hue, sat, value = (c[: max(1, int(len(crop) * 0.4))] for c in hue_saturation_value(crop))
    out[:HUES], out[HUES : HUES + SATURATIONS] = shares(hue, HUES, 360), shares(sat, SATURATIONS, 1)
    out[-4:-1] = hue.mean() / 360, sat.mean(), value.mean()
    grey = crop @ GREY
    if min(grey.shape) >= 3:
        out[-1] = min(1.0, (np.abs(np.diff(grey, axis=0)).mean() + np.abs(np.diff(grey, axis=1)).mean()) / 100)
    return out


def image_stats(images: DataFrame, key: str) -> DataFrame:
    """(key, width, height, means of channels, of the largest channel, and of the chroma) of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                rgb = decoded(h, w, c, data)
                if rgb is None:
                    rows.append([None] * len(STATS))
                    continue
                most, least = rgb.max(2), rgb.min(2)
                rows.append([*rgb.mean((0, 1)).tolist(), float(most.mean()), float(np.mean((most - least) / np.maximum(most, 1)))])
            columns = [pa.array(list(x), pa.float64()) for x in zip(*rows, strict=True)] if rows else [pa.nulls(0, pa.float64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), *columns], names=[key, "width", "height", *STATS])

    kind = images.schema[key].dataType.simpleString()
    parts = images.select(key, "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInArrow(run, f"`{key}` {kind}, width int, height int, " + ", ".join(f"{s} double" for s in STATS))


def scene_scores() -> Column:
    """Map from scene tag to score, from the columns of ``image_stats``; without a tag ``general``."""
    grey = (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3
    base = F.greatest(grey, F.lit(1.0))
    dull = (F.col("mean_max") - grey) / F.greatest("mean_max", F.lit(1.0))
    red, green, blue = F.col("mean_r") / base, F.col("mean_g") / base, F.col("mean_b") / base
    rules = [
        ("night", grey < 60, (80 - grey) / 80),
        ("sky", (blue > 1.3) & (grey > 100), blue - 1),
        ("sunset", (red > 1.2) & (grey > 80), (red - 1) * 2),
        ("indoor", (dull < 0.15) & (grey > 60), (0.2 - dull) * 5),
        ("forest", green > 1.15, (green - 1) * 4),
    ]
    return _scores(rules, "general", 0.5)


def style_scores() -> Column:
    """Map from style tag to score: black and white, and the shape of the image."""
    aspect = F.col("width") / F.greatest("height", F.lit(1))
    rules = [
        ("bw", F.col("mean_chroma") < 0.05, (0.1 - F.col("mean_chroma")) * 15),
        ("landscape", aspect > 1.5, aspect - 1),
        ("portrait", aspect < 0.75, 1 - aspect),
        ("square", aspect.between(0.75, 1.5), F.lit(0.5)),
    ]
    return _scores(rules, "color", 0.7)


def _scores(rules: list[tuple[str, Column, Column]], default: str, score: float) -> Column:
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(t).alias("tag"), F.least(F.lit(1.0), s).alias("score"))) for t, test, s in rules]))
    none = F.array(F.struct(F.lit(default).alias("tag"), F.lit(score).alias("score")))
    return F.map_from_entries(F.when(F.size(found) > 0, found).otherwise(none))


def face_pixels(faces: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """(keys, sharpness, size_ratio, head): pixel measures of faces on rows that hold the image and a box.

    A box outside the image has sharpness 0 and ratio 0; an image that is not decoded gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keys)
        for batch in batches:
            out = []
            for h, w, c, data, t, r, b, left in zip(*(batch.column(at + i).to_pylist() for i in range(8)), strict=True):
                rgb = decoded(h, w, c, data)
                if rgb is None or t is None:
                    out.append((None, None, None))
                    continue
                y1, y2, x1, x2 = max(0, t), min(h, b), max(0, left), min(w, r)
                head = head_features(rgb, t, r, b, left).tolist()
                if y2 <= y1 or x2 <= x1:
                    out.append((0.0, 0.0, head))
                else:
                    out.append((sharpness(rgb[y1:y2, x1:x2] @ GREY), (y2 - y1) * (x2 - x1) / (h * w), head))
            a, b_, c_ = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(a, pa.float64()), pa.array(b_, pa.float64()), pa.array(c_, pa.list_(pa.float64()))], names=[*keys, "sharpness", "size_ratio", "head"]
            )

    kinds = ", ".join(f"`{k}` {faces.schema[k].dataType.simpleString()}" for k in keys)
    side = [F.col(f"{box}.{s}").alias(f"_{s}") for s in ("top", "right", "bottom", "left")]
    parts = faces.select(*keys, "image.height", "image.width", "image.nChannels", "image.data", *side)
    return parts.mapInArrow(run, f"{kinds}, sharpness double, size_ratio double, head array<double>")
