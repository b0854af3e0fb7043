"""Images and texts in one space of 64 numbers, without a model: statistics of pixels, and places that words raise.

An image's numbers are, in order: four shares of each colour channel (0 to 11), the brightness's mean, deviation, tenth
and ninetieth percentile (12 to 15), width over height, saturation, edge density (16 to 18), each channel's mean over
the whole mean (19 to 21), brightness of the upper, lower, left and right half (22 to 25) and the variance of small
patches (26). The rest is 0. Both kinds of vector have length 1, or are all 0 where nothing is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import decoded
from .vectors import cosine, norm, present

SIZE = 64

#: What a word adds at places of the vector, if the text contains it.
WORDS = {
    "sunset": {0: 0.24, 4: 0.09, 8: 0.03},
    "nature": {0: 0.06, 4: 0.18, 8: 0.06},
    "beach": {0: 0.09, 4: 0.12, 8: 0.18},
    "snow": {0: 0.21, 4: 0.21, 8: 0.21},
    "night": {0: 0.03, 4: 0.03, 8: 0.045},
    "food": {0: 0.18, 4: 0.12, 8: 0.06},
    "indoor": {0: 0.12, 4: 0.105, 8: 0.09},
    "city": {0: 0.09, 4: 0.09, 8: 0.105},
}
#: Fixed values: (any of these words, place, amount), added once.
ANY = [
    (("night", "dark"), 12, -0.5),
    (("snow", "bright"), 12, 0.5),
    (("portrait", "person", "people"), 16, 0.3),
    (("landscape", "panorama"), 16, -0.3),
    (("colorful", "vivid"), 17, 0.3),
]
#: One of these as a whole word adds to all colour shares.
PEOPLE, PEOPLE_GAIN = ["person", "people", "face", "portrait", "party", "wedding"], 0.05


def _mean(x: np.ndarray) -> float:
    return float(x.mean()) if x.size else 0.0


def patch_variance(grey: np.ndarray) -> float:
    """Mean variance of square patches, an eighth of the height wide; those that touch the last row or column are left out."""
    side = max(len(grey) // 8, 1)
    down, along = ((n - 1) // side for n in grey.shape)
    if not down or not along:
        return 0.0
    tiles = grey[: down * side, : along * side].reshape(down, side, along, side)
    return float(tiles.var(axis=(1, 3)).mean())


def image_vector(rgb: np.ndarray) -> np.ndarray:
    """The numbers of one image; a half or an edge that a side of one pixel lacks counts as 0."""
    height, width = rgb.shape[:2]
    grey, top = rgb.mean(2), rgb.max(2)
    bins = [np.histogram(rgb[..., c], 4, (0, 256))[0] / (height * width + 1e-8) for c in range(3)]
    edges = _mean(np.abs(np.diff(grey, axis=1))) + _mean(np.abs(np.diff(grey, axis=0)))
    halves = [grey[: height // 2], grey[height // 2 :], grey[:, : width // 2], grey[:, width // 2 :]]
    numbers = np.concatenate([
        *bins,
        [grey.mean(), grey.std(), *np.percentile(grey, [10, 90])],
        [width / height, ((top - rgb.min(2)) / (top + 1e-8)).mean(), edges],
        rgb.mean((0, 1)) / max(rgb.mean(), 1),
        [_mean(h) for h in halves],
        [patch_variance(grey)],
    ])
    out = np.zeros(SIZE)
    out[: len(numbers)] = numbers
    return out / (np.linalg.norm(out) or 1)


def image_vectors(images: DataFrame, key: str) -> DataFrame:
    """(key, vector) of rows of Spark's ``image`` source; an image that cannot be decoded has a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(1, 4)), batch.column(4), strict=True)
            made = [None if (rgb := decoded(h, w, c, data.as_py())) is None else image_vector(rgb).tolist() for h, w, c, data in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=[key, "vector"])

    parts = images.select(key, "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInArrow(run, f"`{key}` {images.schema[key].dataType.simpleString()}, vector array<double>")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def text_vector(text: Column) -> Column:
    """The numbers of a text, as an expression; a null text has a null vector, one without known words all zeros."""
    found = [[w] for w in WORDS] + [list(words) for words, _, _ in ANY]
    gains = list(WORDS.values()) + [{place: amount} for _, place, amount in ANY] + [dict.fromkeys(range(12), PEOPLE_GAIN)]

    def marks(low: Column) -> Column:
        whole = F.arrays_overlap(F.split(low, r"(?U)\s+"), F.array(*[F.lit(w) for w in PEOPLE]))
        return F.array(*[F.greatest(*[low.contains(w) for w in words]) if len(words) > 1 else low.contains(words[0]) for words in found], whole)

    def numbers(mark: Column) -> Column:
        def at(place: int) -> Column:
            terms = [F.when(F.get(mark, i), float(g[place])).otherwise(0.0) for i, g in enumerate(gains) if place in g]
            return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

        return F.array(*[at(i) for i in range(SIZE)])

    def scaled(v: Column) -> Column:
        return _let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return F.when(text.isNotNull(), _let(_let(_let(F.lower(text), marks), numbers), scaled))


def images_for_text(vectors: DataFrame, key: str, text: str, k: int = 20, least: float = 0.3) -> DataFrame:
    """(key, score): the ``k`` images whose ``vector`` has the largest cosine with a text's, at least ``least``; of equals the first by key.

    The text's vector is a constant of the plan; nothing is shuffled but each task's best. Scores are rounded to six places.
    Null vectors, vectors of another length or with null entries are passed over.
    """
    own = vectors.sparkSession.range(1).select(text_vector(F.lit(text)).alias("v")).first()["v"]
    rows = vectors.where(present(F.col("vector"), SIZE))
    scored = rows.select(key, F.round(cosine(F.col("vector"), F.array(*[F.lit(x) for x in own]), 1e-8), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)
