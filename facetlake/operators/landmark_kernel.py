"""A Gaussian-kernel classifier of vectors by landmarks: least-squares margins of each cluster against the rest.

Rows become their similarities to a bounded number of landmark rows, made orthogonal (Nystrom features). The margins
of all clusters follow from one matrix of products of features and one sum of features for each cluster, which add up
over tasks: one pass over all rows trains every cluster, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from facetlake.functions.vectors import present

from .clusters import NOISE, _few

#: Steepnesses of the confidence that the held-out rows choose from.
SLOPES = [2.0**i for i in range(-2, 8)]


@dataclass
class Basis:
    """Landmarks, the kernel's width, and what makes similarities to them orthogonal features."""

    points: np.ndarray
    gamma: float
    turn: np.ndarray

    def features(self, v: np.ndarray) -> np.ndarray:
        far = (v * v).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * v @ self.points.T
        return np.exp(-self.gamma * np.maximum(far, 0)) @ self.turn


@dataclass
class LandmarkClassifier:
    basis: Basis
    weights: np.ndarray
    labels: list[int]
    slope: float


def fit_basis(known: DataFrame, id_col: str, vec_col: str, landmarks: int = 256) -> Basis:
    """The ``landmarks`` rows whose ids have the smallest hashes, and the width 1 / (length x variance) over all rows."""
    v = F.col(vec_col)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    s = known.agg(F.sum(total).alias("s"), F.sum(square).alias("q"), F.sum(F.size(v)).alias("n"), F.max(F.size(v)).alias("d")).first()
    spread = s["q"] / s["n"] - (s["s"] / s["n"]) ** 2
    gamma = 1 / (s["d"] * spread) if spread > 1e-12 else 1.0
    chosen = known.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(landmarks).collect()
    points = np.unique(np.array([r[1] for r in chosen], np.float64), axis=0)
    far = ((points[:, None] - points[None]) ** 2).sum(2) if len(points) <= 64 else (points**2).sum(1)[:, None] + (points**2).sum(1) - 2 * points @ points.T
    values, vectors = np.linalg.eigh(np.exp(-gamma * np.maximum(far, 0)))
    keep = values > 1e-9 * values.max()
    return Basis(points, gamma, vectors[:, keep] / np.sqrt(values[keep]))


def _sums(known: DataFrame, vec_col: str, label: str, basis: Basis, many: int = 10_000) -> DataFrame:
    """(label, part, sums, n): sums of features by label, and under a null label the rows of their product matrix."""
    size = basis.turn.shape[1]
    kind = known.schema[label].dataType
    arrow = pa.schema([("label", to_arrow_type(kind)), ("part", pa.int32()), ("sums", pa.list_(pa.float64())), ("n", pa.int64())])
    schema = f"label {kind.simpleString()}, part int, sums array<double>, n long"

    def out(found: dict) -> pa.RecordBatch:
        rows = [(c, p, s.tolist(), n) for (c, p), (s, n) in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, rows, found = np.zeros((size, size)), 0, {}
        for batch in batches:
            z = basis.features(np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)) if len(batch) else np.zeros((0, size))
            product, rows = product + z.T @ z, rows + len(batch)
            labels, place = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            part = np.zeros((len(labels), size))
            np.add.at(part, place, z)
            for c, s, n in zip(labels.tolist(), part, np.bincount(place, minlength=len(labels)).tolist(), strict=True):
                old, m = found.get((c, 0), (0.0, 0))
                found[c, 0] = (old + s, m + n)
            if len(found) > many:
                yield out(found)
                found = {}
        if rows:
            yield out(found | {(None, i): (product[i], rows) for i in range(size)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for c, p, s, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                old, m = found.get((c, p), (0.0, 0))
                found[c, p] = (old + np.array(s), m + n)
        if found:
            yield out(found)

    rows = known.select(F.col(label).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(partial, schema).repartition("label", "part").mapInArrow(summed, schema)


def _fitted(known: DataFrame, vec_col: str, label: str, basis: Basis, ridge: float, most: int) -> tuple[np.ndarray, list[int]]:
    rows = _few(_sums(known, vec_col, label, basis), most + basis.turn.shape[1]).collect()
    product = np.array([r["sums"] for r in sorted((r for r in rows if r["label"] is None), key=lambda r: r["part"])])
    own = sorted((r for r in rows if r["label"] is not None), key=lambda r: r["label"])
    sums = np.array([r["sums"] for r in own])
    # A row of its own cluster wants a margin of 1, any other -1; what all margins have in common goes with it.
    wanted = 2 * sums - sums.sum(0)
    return np.linalg.solve(product + ridge * np.eye(len(product)), wanted.T), [r["label"] for r in own]


def train(
    rows: DataFrame, id_col: str, vec_col: str, label: str, landmarks: int = 256, ridge: float = 1.0, held: int = 5, most: int = 100_000
) -> LandmarkClassifier | None:
    """None with fewer than two clusters. Noise, null labels and rows without a whole vector are left out, here and in ``predict``.

    The landmarks are a bounded sample; every row counts in the margins. One row in ``held``, by the hash of its id, is kept out of a first fit
    and says how steep confidences rise with margins (least log loss); without such rows the slope is 1. The driver holds a
    matrix of landmarks by landmarks and a row for each cluster; more than ``most`` clusters are an error.
    """
    known = rows.where((F.col(label) != NOISE) & present(F.col(vec_col)))
    first = known.select(F.size(vec_col)).first()
    if first is None or len(known.select(label).distinct().limit(2).collect()) < 2:
        return None
    known = known.where(F.size(vec_col) == first[0])
    basis = fit_basis(known, id_col, vec_col, landmarks)
    out = F.pmod(F.xxhash64(F.lit("held"), id_col), F.lit(held)) == 0
    slope, kept = 1.0, known.where(~out)
    if len(kept.select(label).distinct().limit(2).collect()) == 2:
        weights, labels = _fitted(kept, vec_col, label, basis, ridge, most)
        trial = LandmarkClassifier(basis, weights, labels, 1.0)
        losses = _margins(known.where(out), trial, label, vec_col).agg(*[F.sum(F.get("losses", F.lit(i))).alias(f"l{i}") for i in range(len(SLOPES))]).first()
        if losses["l0"] is not None:
            slope = SLOPES[int(np.argmin(list(losses)))]
    weights, labels = _fitted(known, vec_col, label, basis, ridge, most)
    return LandmarkClassifier(basis, weights, labels, slope)


def _margins(rows: DataFrame, c: LandmarkClassifier, keep: str, vec_col: str) -> DataFrame:
    """(keep, cluster, margin, confidence, losses): the best cluster; ``losses`` takes ``keep`` as the true one, null where it was not learned."""
    kind = rows.schema[keep].dataType
    names = ["keep", "cluster", "margin", "confidence", "losses"]
    types = [to_arrow_type(kind), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    labels, step = np.array(c.labels, np.int64), max(1, 4_000_000 // len(c.labels))
    place = {x: i for i, x in enumerate(c.labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                f = np.round(c.basis.features(np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)) @ c.weights, 9)
                best = f.argmax(1)
                top = f[np.arange(len(f)), best]
                below = f - top[:, None]
                share = 1 / np.exp(c.slope * below).sum(1)
                true = [place.get(k) for k in batch.column(0).to_pylist()]
                log = [np.log(np.exp(s * below).sum(1)) for s in SLOPES]
                losses = [None if t is None else [float(x[i] - s * below[i, t]) for s, x in zip(SLOPES, log, strict=True)] for i, t in enumerate(true)]
                columns = [batch.column(0), labels[best], top, share, losses]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    usable = rows.where(present(F.col(vec_col), c.basis.points.shape[1])).select(F.col(keep).alias("keep"), F.col(vec_col).cast("array<double>").alias("v"))
    return usable.mapInArrow(run, f"keep {kind.simpleString()}, cluster long, margin double, confidence double, losses array<double>")


def predict(rows: DataFrame, classifier: LandmarkClassifier, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, method, cluster, confidence, margin), ready for ``classify.weighted_vote``; of equal margins the smallest cluster."""
    made = _margins(rows, classifier, id_col, vec_col)
    return made.select(F.col("keep").alias("query_id"), F.lit("svm").alias("method"), F.col("cluster").cast("int").alias("cluster"), "confidence", "margin")
