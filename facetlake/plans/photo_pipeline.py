"""From detected faces to folders: filter, cluster, merge, map, rate, plan."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import boxes
from facetlake.functions.vectors import composite
from facetlake.operators import clusters, search, workspace
from facetlake.operators.hierarchy import hdbscan


@dataclass
class PhotoResult:
    faces: DataFrame
    confidences: DataFrame
    plan: DataFrame


def usable(faces: DataFrame, s: SimpleNamespace) -> DataFrame:
    """Faces that are sure, large and good enough and have a vector; the primary face is chosen among those."""
    good = (F.col("confidence") >= s.detection_confidence) & boxes.large_enough(F.col("box"), s.min_face_size) & F.col("embedding").isNotNull()
    rows = faces.where(good & (F.coalesce("quality", F.lit(1.0)) >= s.min_face_quality))
    return rows.withColumn("face_id", F.concat_ws(":", "path", F.col("face_index").cast("string")))


def cluster_faces(faces: DataFrame, s: SimpleNamespace) -> DataFrame:
    """(face_id, path, label, ...): density clusters, flat or hierarchical, then similar clusters merged."""
    if s.cluster_method == "hdbscan":
        return _merged(faces.join(_hierarchical(faces, "embedding", s), "face_id"), s)
    eps = s.eps
    if s.auto_eps:
        near = search.top_neighbours(faces, faces, "face_id", "embedding", 5)
        eps = clusters.elbow(clusters.k_distances(near, 5)).first()["eps"]
    return _merged(faces.join(clusters.dbscan(faces, "face_id", "embedding", eps, s.min_samples), "face_id"), s)


def _hierarchical(faces: DataFrame, vec_col: str, s: SimpleNamespace, half_square: bool = False) -> DataFrame:
    """(face_id, label, probability)."""
    return hdbscan(faces, "face_id", vec_col, s.min_samples, s.min_cluster_size, s.cluster_selection_epsilon, s.cluster_selection_method, half_square)


def _merged(labelled: DataFrame, s: SimpleNamespace) -> DataFrame:
    new = clusters.merged_labels(labelled, "label", "embedding", s.merge_threshold, s.min_reliable_size, s.small_merge_threshold)
    number = F.element_at(F.create_map(*[F.lit(x) for pair in new.items() for x in pair]), F.col("label"))
    return labelled.withColumn("label", number.cast("int"))


def recluster(faces: DataFrame, s: SimpleNamespace, names: dict[int, str], head_col: str | None = None, weight: float = 0.2) -> tuple[DataFrame, dict[int, str]]:
    """(faces with new labels, names): stored faces clustered with other settings; a number that is still there keeps its name.

    With ``head_col`` the distance blends faces and heads, and ``eps`` is of that distance; every face needs a head then.
    Fewer than two faces, and settings under which no cluster is left, are errors.
    """
    if faces.limit(2).count() < 2:
        raise ValueError("needs at least two faces")
    if head_col is None:
        made = cluster_faces(faces.drop("label"), s)
    else:
        if faces.where(F.col(head_col).isNull()).limit(1).count():
            raise ValueError("a face has no head")
        rows = faces.drop("label").withColumn("_both", composite(F.col("embedding"), F.col(head_col), weight))
        # The vectors have length 1, so half the square of their distance is the blended one.
        flat = s.cluster_method == "dbscan"
        labels = clusters.dbscan(rows, "face_id", "_both", (2 * s.eps) ** 0.5, s.min_samples) if flat else _hierarchical(rows, "_both", s, True)
        made = _merged(rows.drop("_both").join(labels, "face_id"), s)
    made = clusters.cut(made)
    left = {r[0] for r in made.where(F.col("label") != clusters.NOISE).select("label").distinct().collect()}
    if not left:
        raise ValueError("no cluster is left under these settings")
    return made, {c: n for c, n in names.items() if c in left}


def run(images: DataFrame, faces: DataFrame, s: SimpleNamespace) -> PhotoResult:
    """``images``: (path, width, height, error, skipped); ``faces``: (path, face_index, box, confidence, quality, embedding)."""
    rows = usable(faces, s).join(images.where(F.col("error").isNull()).select("path", "width", "height"), "path")
    rows = boxes.primary_faces(rows, "path", "face_index", F.col("box"), F.col("confidence"), F.col("width"), F.col("height"))
    rows = clusters.cut(cluster_faces(rows, s))
    members = rows.select("path", F.col("label").alias("cluster")).distinct()
    sides = rows.select("path", F.col("label").alias("cluster"), "is_primary")
    kept = workspace.export_members(members, sides, s.multi_face_strategy, photo="path")
    counts = faces.groupBy("path").agg(F.count("*").alias("faces"))
    state = images.join(counts, "path", "left").withColumn("faces", F.coalesce("faces", F.lit(0)))
    plan = workspace.organise(state, kept, "path", "cluster", "faces", "error", "skipped", s.folder_prefix)
    wanted = ~F.col("folder").isin([n for n, on in (("_unclustered", s.include_unclustered), ("_no_faces", s.include_no_faces)) if not on])
    return PhotoResult(rows, clusters.confidences(rows, "label", "embedding"), workspace.unique_destinations(plan.where(wanted), "folder", "path"))


def should_optimise(total: int, fresh: int, force: bool = False, least: int = 100, many: int = 5000) -> bool:
    """Whether all faces should be clustered anew: on demand, or after ``many`` new ones in a library of ``least``."""
    return force or (total >= least and fresh >= many)
