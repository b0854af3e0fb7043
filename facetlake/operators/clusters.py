"""Clusters of vectors: centroids, confidence, merging, drift; density clustering is in ``density``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.vectors import dot, unit

from .density import NOISE, dbscan  # noqa: F401
from .numbering import cut, numbered_in_order  # noqa: F401


def mapping(faces: DataFrame, label: str, path: str) -> DataFrame:
    """(label, paths): the sorted distinct paths of each cluster; noise is left out."""
    return faces.where(F.col(label) != NOISE).groupBy(label).agg(F.sort_array(F.collect_set(path)).alias("paths"))


def centroids(faces: DataFrame, label: str, vec_col: str, weight: Column | None = None) -> DataFrame:
    """(label, centroid, member_count, total_weight): the weighted mean of unit vectors, as a unit vector.

    Sums are by label and place of the vector, so partial sums meet and no cluster
    has to fit a task.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = faces.where(F.col(label) != NOISE).select(label, w.alias("w"), F.posexplode(unit(F.col(vec_col))).alias("pos", "x"))
    sums = rows.groupBy(label, "pos").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    packed = sums.groupBy(label).agg(
        F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("v"), F.max("n").alias("member_count"), F.max("w").alias("total_weight")
    )
    return packed.select(label, unit(F.transform("v", lambda p: p["s"])).alias("centroid"), "member_count", "total_weight")


def confidences(faces: DataFrame, label: str, vec_col: str) -> DataFrame:
    """(label, confidence): mean similarity to the centroid, lowered by half its spread over .15; single members have 1."""
    own = faces.where(F.col(label) != NOISE).join(F.broadcast(_few(centroids(faces, label, vec_col))), label)
    sims = own.select(label, dot(unit(F.col(vec_col)), F.col("centroid")).alias("sim"))
    agg = sims.groupBy(label).agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"), F.count("*").alias("n"))
    m = F.least(F.greatest("m", F.lit(0.0)), F.lit(1.0))
    value = m * (1 - 0.5 * F.least(F.lit(1.0), F.col("s") / 0.15))
    return agg.select(label, F.when(F.col("n") == 1, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("confidence"))


def _few(small: DataFrame, most: int = 100_000) -> DataFrame:
    """``small``, checked to be small enough to broadcast."""
    n = small.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return small


def k_distances(neighbours: DataFrame, k: int) -> DataFrame:
    """(position, distance): sorted Euclidean distances to the k-th neighbour, from ranked cosine similarities."""
    d = F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0)))
    own = neighbours.where(F.col("rank") == k).select("query_id", F.round(d, 6).alias("distance"))
    return numbered_in_order(own, ["distance", "query_id"], "position").select("position", "distance")


def elbow(distances: DataFrame, fallback: float = 0.5) -> DataFrame:
    """(eps): the distance farthest from the chord of the sorted curve; the first of equals."""
    span = distances.agg(F.max("position").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    scaled = distances.crossJoin(F.broadcast(span)).select(
        "position",
        "distance",
        F.abs(
            F.col("position") / F.greatest("n", F.lit(1))
            - (F.col("distance") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
        ).alias("gap"),
    )
    best = scaled.agg(F.max(F.struct(F.round("gap", 9).alias("gap"), (-F.col("position")).alias("first"), "distance")).alias("b"))
    return best.select(F.coalesce("b.distance", F.lit(fallback)).alias("eps"))


def drift(before: DataFrame, after: DataFrame, id_col: str, label: str) -> DataFrame:
    """(common, changed, drift, new_clusters): the share of common faces whose cluster changed, 0 without any."""
    both = before.select(id_col, F.col(label).alias("old")).join(after.select(id_col, F.col(label).alias("new")), id_col)
    counts = both.agg(F.count("*").alias("common"), F.count(F.when(F.col("old") != F.col("new"), 1)).alias("changed"))
    fresh = after.select(label).distinct().join(before.select(label).distinct(), label, "left_anti").agg(F.count("*").alias("new_clusters"))
    share = F.when(F.col("common") > 0, F.col("changed") / F.col("common")).otherwise(0.0)
    return counts.crossJoin(fresh).select("common", "changed", F.round(share, 6).alias("drift"), "new_clusters")


def named(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id_col, name): ``cluster_<label>``, and ``noise_<id>`` for each point of noise."""
    own = F.concat(F.lit("cluster_"), F.col(label).cast("string"))
    return labels.select(id_col, F.when(F.col(label) == NOISE, F.concat(F.lit("noise_"), F.col(id_col).cast("string"))).otherwise(own).alias("name"))


def merged_labels(faces: DataFrame, label: str, vec_col: str, threshold: float = 0.85, min_reliable: int = 10, small_threshold: float = 0.75) -> dict[int, int]:
    """Old label to new: the most similar pair of clusters above its threshold merges, again and again.

    A pair with a cluster below ``min_reliable`` needs only ``small_threshold``. The
    driver holds one sum of vectors for each cluster; new labels are 0, 1, ... in the
    order of the old ones, noise stays.
    """
    rows = _few(centroids(faces, label, vec_col), 5000).collect()
    rows.sort(key=lambda r: r[label])
    ids = [r[label] for r in rows]
    sizes = {i: r["member_count"] for i, r in zip(ids, rows, strict=True)}
    sums = {r[label]: np.array(x) for r, x in zip(rows, [r["v"] for r in sorted(_sums(faces, label, vec_col).collect(), key=lambda r: r[label])], strict=True)}
    target = {i: i for i in ids}
    while len(ids) > 1:
        m = np.array([sums[i] / (np.linalg.norm(sums[i]) + 1e-10) for i in ids])
        sim = np.triu(m @ m.T, 1)
        n = np.array([sizes[i] for i in ids])
        small = (n[:, None] < min_reliable) | (n[None, :] < min_reliable)
        sim[sim < np.where(small, small_threshold, threshold)] = 0
        a, b = divmod(int(sim.argmax()), len(ids))
        if sim[a, b] <= 0:
            break
        keep, gone = ids[a], ids[b]
        sums[keep], sizes[keep] = sums[keep] + sums[gone], sizes[keep] + sizes[gone]
        target = {k: keep if v == gone else v for k, v in target.items()}
        ids.remove(gone)
    number = {k: i for i, k in enumerate(sorted(set(target.values())))}
    return {k: number[v] for k, v in target.items()} | {NOISE: NOISE}


def _sums(faces: DataFrame, label: str, vec_col: str) -> DataFrame:
    rows = faces.where(F.col(label) != NOISE).select(label, F.posexplode(unit(F.col(vec_col))).alias("pos", "x"))
    sums = rows.groupBy(label, "pos").agg(F.sum("x").alias("s")).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("v"))
    return sums.select(label, F.transform("v", lambda p: p["s"]).alias("v"))
