"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other signs. Features are
tokens, pairs of neighbouring tokens, pairs of neighbouring token shapes, and
whether neighbouring words are the same; each is hashed to ``2**bits`` places. A
text's vector holds the root of each feature's share, so long and short texts
weigh alike, and is scored whole as one sparse dot product.

Training reads at most ``max_rows`` labelled rows, those first in the order of the
hash of their id. That bound makes it work for one task: follow-the-regularised-leader
goes through the rows in a shuffled order, ``passes`` times, and keeps its state (the sums of
gradients and of their squares for each place) from the first row to the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .textarrays import SIGN_CLASS, chunks, mixed, tokens

#: Letters and digits as shapes: capitals 1, other letters 2, digits 3; other signs keep their byte.
SHAPE = np.arange(256).astype(np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 1, 2, 2, 3


#: Rows that a model is fitted on, about.
MAX_ROWS = 6_000
MOST_ROWS = 2**31 - 1


@dataclass
class QualityModel:
    bits: int
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of a chunk's hashed features, sorted by row and place."""
    hashes, starts, _, bounds = tokens(data, offsets, SIGN_CLASS)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    shapes = SHAPE[data]
    # A token's shape: its first two signs' kinds.
    second = shapes[np.minimum(starts + 1, len(data) - 1)] if len(data) else shapes[:0]
    shape = shapes[starts].astype(np.uint64) * np.uint64(256) + second
    inside = np.flatnonzero(row[1:] == row[:-1])
    two = inside[row[np.minimum(inside + 2, len(row) - 1)] == row[inside]] if len(inside) else inside
    two = two[two + 2 < len(row)]
    code = [
        hashes,
        mixed(hashes[inside] * np.uint64(3) + hashes[inside + 1]),
        mixed(shape[inside] * np.uint64(1 << 20) + shape[inside + 1] + np.uint64(7 << 50)),
        np.where(hashes[inside] == hashes[inside + 1], np.uint64(11), np.uint64(12)),
        np.where(hashes[two] == hashes[two + 2], np.uint64(13), np.uint64(14)),
    ]
    code[3:] = [mixed(c) for c in code[3:]]
    at = [row, row[inside], row[inside], row[inside], row[two]]
    place = np.concatenate([c & np.uint64((1 << bits) - 1) for c in code]).astype(np.int64)
    key, n = np.unique((np.concatenate(at) << bits) | place, return_counts=True)
    row, place = key >> bits, key & ((1 << bits) - 1)
    value = np.sqrt(n)
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return row, place, value / np.maximum(norm[row], 1e-9)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def score_chunk(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row, place, value = features(data, offsets, model.bits)
    return _sigmoid(model.bias + np.bincount(row, model.weights[place] * value, len(offsets) - 1))


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], places: int, alpha: float, beta: float, l1: float, l2: float, passes: int
) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader with a learning rate for each place.

    ``rows`` are (places, values, label) without repeated places; the bias is one place more, with value 1.
    """
    z, n = np.zeros(places + 1), np.zeros(places + 1)

    def lead(at: np.ndarray | slice) -> np.ndarray:
        pull = np.abs(z[at]) - l1
        return np.where(pull <= 0, 0.0, -np.sign(z[at]) * pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for place, value, label in rows:
            at, x = np.append(place, places), np.append(value, 1.0)
            own = lead(at)
            g = (_sigmoid(own @ x) - label) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * own
            n[at] = more
    w = lead(slice(None))
    return w[:-1], float(w[-1])


def sample_rows(rows: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id_col, label_col) of at most ``max_rows`` ids with a label, the first in a hashed order.

    An id that repeats counts once, with its largest label. Null ids and labels are left out.
    A bound above ``MOST_ROWS``, the most that a limit can be, keeps every id.
    """
    labelled = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    once = labelled.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    if max_rows > MOST_ROWS:
        return once
    return once.orderBy(F.xxhash64(F.col(id_col), F.lit("quality")), id_col).limit(max_rows)


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = 18,
    max_rows: int | None = MAX_ROWS,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.0005,
    l2: float = 0.001,
    passes: int = 6,
) -> QualityModel:
    """Fits the model on rows of (id, text, label 0 or 1).

    Rows with a null label are not used; null texts are empty. Of rows that repeat an id one is
    used, by the order of its text's hash. ``max_rows`` bounds the sample; None says that the rows are such a
    sample already. Without a row the model scores every text 0.5.
    """
    rows = labelled.where(F.col(label_col).isNotNull())
    if max_rows is not None:
        rows = rows.join(F.broadcast(sample_rows(rows, id_col, label_col, max_rows)), [id_col, label_col], "left_semi")
    order = F.xxhash64(F.col(id_col), F.lit("part"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.select(order.alias("key"), F.col(label_col).cast("int").alias("label"), text.alias("text"))
    rows = rows.groupBy("key").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("r")).select("key", "r.label", "r.text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                row, place, value = features(data, offsets, bits)
                cut = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(1).slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(place.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32))),
                    ],
                    names=["key", "label", "place", "value"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for batch in batches:
            labels = batch.column(1).to_pylist()
            places, values = (c.values.to_numpy(zero_copy_only=False) for c in (batch.column(2), batch.column(3)))
            cut = batch.column(2).offsets.to_numpy()
            data += [(places[a:b].astype(np.int64), values[a:b].astype(float), y) for a, b, y in zip(cut[:-1], cut[1:], labels, strict=True)]
        w, bias = ftrl(data, 1 << bits, alpha, beta, l1, l2, passes)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias))], names=["place", "w"])

    vector = stored(rows.mapInArrow(vectors, "key long, label int, place array<int>, value array<float>"), "vectors")
    # A hashed order of ids is a shuffled one, and the same in every run.
    fitted = vector.repartition(1).sortWithinPartitions("key").mapInArrow(fit, "place long, w double").toArrow()
    weights, bias = np.zeros(1 << bits), 0.0
    place, w = fitted.column("place").to_numpy(), fitted.column("w").to_numpy()
    weights[place[place >= 0]] = w[place >= 0]
    bias = float(w[place < 0].sum())
    return QualityModel(bits, weights.astype(np.float32), bias)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, score, predicted) for every whole text; one row for each row of ``docs``.

    ``predicted`` is 1 from ``threshold`` on. A null or empty text has no feature
    and gets the score of the bias. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                score = score_chunk(sent.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``threshold`` or more."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(place)):
                yield batch.slice(row, end - row).filter(pa.array(score_chunk(sent.value, data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
