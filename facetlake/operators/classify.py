"""Assigning faces to clusters: neighbour votes, centroids, ensembles, corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from facetlake.functions.vectors import present, unit

from .clusters import NOISE, _few
from .numbering import cut, numbered_in_order
from .search import Best, blocks, matrix_of, slices


def neighbour_votes(neighbours: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(query_id, cluster, votes, best, first_rank): votes of ranked neighbours that have a cluster."""
    named = neighbours.join(labels.select(id_col, F.col(label).alias("cluster")), id_col, "left").where(F.col("cluster").isNotNull())
    return named.groupBy("query_id", "cluster").agg(F.count("*").alias("votes"), F.max("similarity").alias("best"), F.min("rank").alias("first_rank"))


def majority(votes: DataFrame) -> DataFrame:
    """(query_id, cluster, votes, best): the most votes; of equals the cluster of the nearest neighbour."""
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "first_rank")
    return votes.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "cluster", "votes", "best")


def assign_incrementally(
    new: DataFrame,
    neighbours: DataFrame,
    labels: DataFrame,
    id_col: str,
    label: str,
    high: float = 0.4,
    medium: float = 0.55,
    fresh: float = 0.65,
    first_number: int = 0,
) -> DataFrame:
    """(id_col, cluster_id, confidence, method) for every new face, each on its own.

    ``high``: the nearest neighbour is closer than 1 - high and has a cluster.
    ``medium``: two or more votes and a best score above 1 - medium.
    ``new_cluster``: no neighbour, or the nearest below 1 - fresh; numbered in order
    of the face's id from ``first_number`` on, the first that no batch before used. Else ``pending``, without a cluster.
    """
    top = neighbours.where("rank = 1").join(labels.select(id_col, F.col(label).cast("string").alias("top_cluster")), id_col, "left")
    best = majority(neighbour_votes(neighbours, labels, id_col, label))
    rows = (
        new.select(F.col(id_col).alias("query_id"))
        .join(top.select("query_id", F.col("similarity").alias("top"), "top_cluster"), "query_id", "left")
        .join(best.select("query_id", F.col("cluster").cast("string").alias("voted"), "votes", "best"), "query_id", "left")
    )
    method = (
        F.when(F.col("top").isNull(), "new_cluster")
        .when((F.col("top") > 1 - high) & F.col("top_cluster").isNotNull(), "high")
        .when((F.col("votes") >= 2) & (F.col("best") > 1 - medium), "medium")
        .when(F.col("top") < 1 - fresh, "new_cluster")
        .otherwise("pending")
    )
    rows = rows.withColumn("method", method)
    made = rows.where("method = 'new_cluster'").select("query_id")
    rows = rows.join(numbered_in_order(made, ["query_id"], "n"), "query_id", "left")
    cluster = (
        F.when(F.col("method") == "high", F.col("top_cluster"))
        .when(F.col("method") == "medium", F.col("voted"))
        .when(F.col("method") == "new_cluster", F.format_string("inc_%06d", F.col("n") + first_number))
    )
    confidence = F.when(F.col("method") == "new_cluster", 1.0).when(F.col("method") == "medium", F.col("best")).otherwise(F.col("top"))
    return rows.select(F.col("query_id").alias(id_col), cluster.alias("cluster_id"), confidence.alias("confidence"), "method")


def nearest_centroid(
    faces: DataFrame, prototypes: DataFrame, id_col: str, vec_col: str, label: str, exclude: list[int] | None = None, most: int = 100_000
) -> DataFrame:
    """(id_col, predicted, confidence): the prototype at the least cosine distance, the smallest label of equals.

    Prototypes named in ``exclude`` do not stand for choice. A vector that is null or zero, and any vector without a
    prototype, has no prediction and confidence 0. At most ``most`` prototypes are sent to the tasks, as one matrix; a
    batch of faces is one product with it, and nothing is shuffled.
    """
    rows = prototypes.where(~F.col(label).isin(exclude)) if exclude else prototypes
    own = _few(rows.select(F.col(label).cast("int").alias("cluster"), unit(F.col("centroid")).alias("c")), most).orderBy("cluster").toArrow()
    labels = np.array(own.column("cluster").to_pylist(), np.int64)
    matrix = np.array(own.column("c").to_pylist(), np.float64)
    sent = faces.sparkSession.sparkContext.broadcast((labels, matrix))
    kind = faces.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                vectors = part.column(1).to_pylist()
                known = np.array([v is not None and any(v) for v in vectors], bool) & (len(labels) > 0)
                predicted, best = np.zeros(len(part), np.int64), np.zeros(len(part))
                if known.any():
                    v = np.array([x for x, k in zip(vectors, known.tolist(), strict=True) if k], np.float64)
                    scores = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) @ matrix.T, 6)
                    at = scores.argmax(1)  # the first of equals: labels are in order
                    predicted[known], best[known] = labels[at], np.maximum(scores[np.arange(len(v)), at], 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predicted, pa.int32(), mask=~known), pa.array(best)], names=[id_col, "predicted", "confidence"])

    return faces.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, f"`{id_col}` {kind}, predicted int, confidence double")


def euclidean_shares(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, label: str, k: int = 5) -> DataFrame:
    """(query_id, cluster, share): the shares of clusters among a query's ``k`` nearest other faces, each by 1 / distance.

    ``queries`` are a stated, gathered set, compared block by block of the corpus; each task keeps its own best ``k``.
    Faces without a whole vector, or of another size than the first query's, are left out.
    """
    whole = queries.where(present(F.col(vec_col)))
    first = whole.select(F.size(vec_col)).first()
    size = first[0] if first else 0
    asked = _few(whole.where(F.size(vec_col) == size).select(id_col, F.col(vec_col).cast("array<double>").alias("v")), 100_000).toArrow()
    ids, vectors = asked.column(0).to_pylist(), np.array(asked.column(1).to_pylist(), np.float64)
    sent = corpus.sparkSession.sparkContext.broadcast((ids, vectors))
    kind, cluster = corpus.schema[id_col].dataType.simpleString(), corpus.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best, lengths = Best(ids, k), (q * q).sum(1) if len(ids) else np.zeros(0)
        for batch in batches:
            for part in slices(batch):
                own, labels, v = part.column(0).to_pylist(), part.column(2).to_pylist(), matrix_of(part.column(1), size)
                squares = (v * v).sum(1)
                # Products say which faces may be near; their distances are then taken from the differences.
                slack = 2e-6 + 1e-6 * float(np.sqrt(max(squares.max(), lengths.max(initial=0.0))))
                for at in blocks(len(ids)):
                    rough = -np.sqrt(np.maximum(lengths[at][:, None] + squares - 2 * (q[at] @ v.T), 0))
                    i, j = best.worth(at, rough, slack)
                    for lo in range(0, len(i), 65_536):
                        x, y = i[lo : lo + 65_536], j[lo : lo + 65_536]
                        best.add(at[x], -np.round(np.sqrt(((v[y] - q[at[x]]) ** 2).sum(1)), 6), y, own, labels)
        flat = best.rows()
        if flat:
            a, s, i, c = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([-x for x in s], pa.float64()), pa.array(i), pa.array(c)], schema=pa.schema([("query_id", batch_types[0]), ("d", pa.float64()), (id_col, batch_types[0]), ("cluster", batch_types[1])]))

    batch_types = [asked.schema.field(0).type, to_arrow_type(corpus.schema[label].dataType)]
    rows = corpus.where(F.col(label).isNotNull() & present(F.col(vec_col), size)).select(id_col, F.col(vec_col).cast("array<double>").alias("v"), label)
    near = rows.mapInArrow(run, f"query_id {kind}, d double, `{id_col}` {kind}, cluster {cluster}")
    order = Window.partitionBy("query_id").orderBy("d", id_col)
    top = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    sums = top.groupBy("query_id", "cluster").agg(F.sum(1 / (F.col("d") + 1e-6)).alias("w"))
    return sums.select("query_id", "cluster", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query_id")), 6).alias("share"))


def best_share(shares: DataFrame) -> DataFrame:
    """(query_id, cluster, share): the largest share of each query, the smallest cluster of equals."""
    order = Window.partitionBy("query_id").orderBy(F.desc("share"), "cluster")
    return shares.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def misclassified(predictions: DataFrame, truth: DataFrame, id_col: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Confident predictions that differ from the known cluster; noise is no cluster."""
    return predictions.join(truth.select(id_col, label), id_col).where(
        (F.col("predicted") != F.col(label)) & (F.col("confidence") >= threshold) & (F.col(label) != NOISE)
    )


def weighted_vote(votes: DataFrame, weights: dict[str, float], reject: float = 0.4) -> DataFrame:
    """(query_id, predicted, confidence): methods' votes (query_id, method, cluster, confidence) by weight.

    The winner's share of all weighted confidence; below ``reject`` nothing is predicted.
    """
    weight = F.coalesce(*[F.when(F.col("method") == m, F.lit(float(w))) for m, w in weights.items()], F.lit(0.0))
    sums = votes.groupBy("query_id", "cluster").agg(F.sum(weight * F.col("confidence")).alias("s"))
    best = sums.groupBy("query_id").agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("cluster")).alias("neg"))).alias("b"), F.sum("s").alias("total"))
    share = F.when(F.col("total") > 0, F.round(F.col("b.s") / F.col("total"), 6)).otherwise(0.0)
    return best.select("query_id", share.alias("confidence"), (-F.col("b.neg")).cast("int").alias("winner")).select(
        "query_id", F.when(F.col("confidence") >= reject, F.col("winner")).alias("predicted"), "confidence"
    )


def adapted_weights(outcomes: DataFrame, method: str, correct: Column, order: list[Column], static: dict[str, float], last: int = 100, least: int = 10) -> DataFrame:
    """(method, weight): the share of right answers among a method's last ones, or its static weight below ``least`` answers; scaled to sum to 1."""
    recent = Window.partitionBy(method).orderBy(*order)
    rows = outcomes.select(method, correct.cast("double").alias("ok"), F.row_number().over(recent).alias("r")).where(F.col("r") <= last)
    base = F.coalesce(*[F.when(F.col(method) == m, F.lit(float(w))) for m, w in static.items()], F.lit(0.0))
    raw = rows.groupBy(method).agg(F.avg("ok").alias("acc"), F.count("*").alias("n")).select(method, F.when(F.col("n") >= least, F.col("acc")).otherwise(base).alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    return raw.select(method, F.round(F.col("w") / total, 6).alias("weight"))


def adapted_thresholds(
    corrections: DataFrame, owner: str, order: list[str], action: Column, start: float = 0.7, step: float = 0.02, low: float = 0.4, high: float = 0.95, width: int = 4096
) -> DataFrame:
    """(owner, threshold, merges, splits): merges lower an owner's threshold, splits raise it, within limits at every step.

    Moving by a sum and staying between two limits is closed under composition, so corrections are put in order over all
    tasks and composed in runs of at most ``width``, then the runs, until an owner is one step: no owner has to fit a task.
    ``order`` should tell an owner's corrections apart; null or other actions move nothing, a null owner is an owner.
    """
    if width < 2:
        raise ValueError("runs have to hold two steps at least")
    inf = F.lit(float("inf"))
    merge, split = (F.coalesce(action == k, F.lit(False)) for k in ("merge", "split"))
    steps = corrections.select(
        F.col(owner).alias("_owner"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.when(merge, -step).when(split, step).otherwise(0.0).alias("move"),
        F.when(merge, low).otherwise(-inf).alias("low"),
        F.when(split, high).otherwise(inf).alias("high"),
        merge.cast("long").alias("merges"),
        split.cast("long").alias("splits"),
    )
    keys, parts = ["_owner", *[f"_o{i}" for i in range(len(order))]], ["move", "low", "high", "merges", "splits"]
    place = F.monotonically_increasing_id().alias("_m")
    runs = cut(steps.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_owner", place, *parts))

    def then(a: Column, b: Column) -> Column:
        held = lambda x: F.least(F.greatest(x + b["move"], b["low"]), b["high"])
        return F.struct(
            (a["move"] + b["move"]).alias("move"), held(a["low"]).alias("low"), held(a["high"]).alias("high"),
            (a["merges"] + b["merges"]).alias("merges"), (a["splits"] + b["splits"]).alias("splits"),
        )

    none = F.struct(F.lit(0.0).alias("move"), (-inf).alias("low"), inf.alias("high"), F.lit(0).cast("long").alias("merges"), F.lit(0).cast("long").alias("splits"))

    def composed(rows: DataFrame, *by: Column) -> DataFrame:
        listed = rows.groupBy("_owner", *by).agg(F.min("_m").alias("_m"), F.array_sort(F.collect_list(F.struct("_m", *parts))).alias("s"))
        return listed.select("_owner", "_m", F.aggregate("s", none, then).alias("f")).select("_owner", "_m", "f.*")

    # Places have the partition above bit 33, so runs grow until those of one owner meet in one group.
    shift, bits = 0, width.bit_length() - 1
    while (runs.groupBy("_owner").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > width:
        shift += bits
        runs = cut(composed(runs, F.shiftright("_m", shift).alias("_run")))
    whole = composed(runs)
    value = F.least(F.greatest(F.lit(start) + F.col("move"), F.col("low")), F.col("high"))
    return whole.select(F.col("_owner").alias(owner), value.alias("threshold"), "merges", "splits")


def adapted_threshold(actions: Column, start: float = 0.7, step: float = 0.02, low: float = 0.4, high: float = 0.95) -> Column:
    """Folds an ordered array of ``merge`` and ``split`` into a threshold: merges lower it, splits raise it, within limits at every step."""
    return F.aggregate(
        actions,
        F.lit(start),
        lambda t, a: F.when(a == "merge", F.greatest(t - step, F.lit(low))).when(a == "split", F.least(t + step, F.lit(high))).otherwise(t),
    )
