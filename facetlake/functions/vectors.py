"""Vector columns (``ARRAY<DOUBLE>`` or ``ARRAY<FLOAT>``) by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def present(v: Column, size: int | None = None) -> Column:
    """Whether there is a vector without null entries, of this size if one is given."""
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    return F.coalesce(whole & (F.size(v) == size) if size is not None else whole, F.lit(False))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where the sizes differ."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def unit(v: Column, floor: float = 1e-10) -> Column:
    """v / max(|v|, floor). The length is an array's only entry, so it is not worked out again for each entry of v."""
    length = F.array(F.greatest(norm(v), F.lit(floor)))
    return F.transform(length, lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine similarity; ``eps`` is added to the product of the lengths, zero vectors give 0."""
    scale = norm(a) * norm(b) + F.lit(eps)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def padded(v: Column, size: Column | int) -> Column:
    """Zeros are appended up to ``size``; a longer vector is an error."""
    size = F.lit(size) if isinstance(size, int) else size
    short = size - F.size(v)
    return F.when(short < 0, F.raise_error(F.lit("vector longer than the common size"))).otherwise(
        F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.greatest(short, F.lit(0))))
    )


def blended(face: Column, head: Column, weight: float) -> Column:
    """(1 - w) of the face distance and w of the head distance, each 1 - cosine kept within 0..2; without a head the face alone."""
    near = F.least(F.greatest(face, F.lit(0.0)), F.lit(2.0))
    if weight <= 0:
        return near
    far = F.least(F.greatest(head, F.lit(0.0)), F.lit(2.0))
    return F.when(head.isNull(), near).otherwise((1 - weight) * near + weight * far)


def composite(face: Column, head: Column, weight: float) -> Column:
    """One vector for a face with a head: 1 - the inner product of two of them is their blended distance.

    The face's direction by the root of 1 - w, then the head's by the root of w. A zero vector keeps distance 1 from
    all others, so these vectors are compared without scaling. Null without a head.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight lies between 0 and 1")
    side = lambda v, w: F.transform(unit(v), lambda x: x * F.lit(w**0.5))
    return F.concat(side(face, 1 - weight), side(head, weight))
