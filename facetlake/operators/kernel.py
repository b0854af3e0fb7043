"""A Gaussian-kernel classifier of vectors: random Fourier features and multinomial logistic regression.

It stands in for a support vector machine with that kernel, which Spark does not
have: the features' inner products approximate the kernel, and the regression is
trained by Spark over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions.vectors import present, unit

from .clusters import NOISE


@dataclass
class KernelClassifier:
    frequencies: np.ndarray
    phases: np.ndarray
    model: Model
    labels: list[int]


def _features(rows: DataFrame, keep: list[str], vec_col: str, frequencies: np.ndarray, phases: np.ndarray) -> DataFrame:
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(len(keep)).to_pylist(), np.float64).reshape(len(batch), len(frequencies))
            z = np.sqrt(2 / len(phases)) * np.cos(v @ frequencies + phases)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(z.tolist(), pa.list_(pa.float64()))], names=[*keep, "z"])

    made = rows.where(present(F.col(vec_col), len(frequencies))).select(*keep, unit(F.col(vec_col)).alias("_v")).mapInArrow(run, f"{kinds}, z array<double>")
    return made.select(*keep, array_to_vector("z").alias("features"))


def train(rows: DataFrame, vec_col: str, label: str, features: int = 256, gamma: float = 1.0, seed: int = 1) -> KernelClassifier | None:
    """None if there are fewer than two classes; noise is no class. Rows without a whole vector are left out, here and in ``predict``."""
    known = rows.where((F.col(label) != NOISE) & present(F.col(vec_col)))
    labels = sorted(r[0] for r in known.select(label).distinct().collect())
    if len(labels) < 2:
        return None
    size = len(known.select(vec_col).first()[0])
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(scale=np.sqrt(2 * gamma), size=(size, features)), rng.uniform(0, 2 * np.pi, features)
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    made = _features(known.withColumn("_y", number.cast("double")), ["_y"], vec_col, frequencies, phases)
    fitted = LogisticRegression(labelCol="_y", regParam=1e-3, maxIter=50, family="multinomial").fit(made)
    return KernelClassifier(frequencies, phases, fitted, labels)


def predict(rows: DataFrame, classifier: KernelClassifier, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, method, cluster, confidence), ready for ``classify.weighted_vote``."""
    made = classifier.model.transform(_features(rows, [id_col], vec_col, classifier.frequencies, classifier.phases))
    p = vector_to_array("probability")
    at = F.col("prediction").cast("int")
    return made.select(
        F.col(id_col).alias("query_id"),
        F.lit("svm").alias("method"),
        F.get(F.array(*[F.lit(x) for x in classifier.labels]), at).alias("cluster"),
        F.get(p, at).alias("confidence"),
    )
