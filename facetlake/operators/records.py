"""Reading and counting records: faces by cluster and image, caches, corrections, libraries, prototypes, job phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import NOISE
from .stores import latest

# -- faces ----------------------------------------------------------------------


def by_key(faces: DataFrame, key: str, values: list) -> DataFrame:
    """The faces with one of these values: ids, clusters or images; a filter that reaches the scan."""
    return faces.where(F.col(key).isin(values))


def face_counts(faces: DataFrame, cluster: str, image: str) -> DataFrame:
    """(faces, images, clusters): how many there are; noise and missing clusters are no clusters."""
    real = F.when(F.col(cluster) != NOISE, F.col(cluster))
    return faces.agg(F.count("*").alias("faces"), F.count_distinct(image).alias("images"), F.count_distinct(real).alias("clusters"))


def cluster_ids(faces: DataFrame, cluster: str) -> DataFrame:
    """The distinct clusters in order, without missing ones."""
    return faces.where(F.col(cluster).isNotNull()).select(cluster).distinct().orderBy(cluster)


def with_head_features(faces: DataFrame, heads: DataFrame, keys: list[str], feature: str, size: int) -> DataFrame:
    """All faces with their head's features: zeros and ``has_head`` false where there are none."""
    joined = faces.join(heads.select(*keys, F.col(feature).cast("array<double>").alias("_head")), keys, "left")
    zeros = F.array_repeat(F.lit(0.0), size)
    return joined.withColumn("has_head", F.col("_head").isNotNull()).withColumn(feature, F.coalesce("_head", zeros)).drop("_head")


def with_metadata(found: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Search results with what is known of their faces; a result without metadata stays, with nulls."""
    return found.join(metadata, key, "left")


def last_cluster(members: DataFrame, photo: str, cluster: str) -> DataFrame:
    """(photo, cluster): the last cluster of a photo that is in several; noise is none."""
    return members.where(F.col(cluster) != NOISE).groupBy(photo).agg(F.max(cluster).alias(cluster))


def best_quality(faces: DataFrame, image: str, quality: str) -> DataFrame:
    """(image, quality): the highest quality of an image's faces, for images where it is above 0."""
    return faces.groupBy(image).agg(F.max(quality).alias(quality)).where(F.col(quality) > 0)


def common_size(faces: DataFrame, vec_col: str) -> DataFrame:
    """(size): the size that most vectors have, the largest of equals; null and empty vectors do not count."""
    sizes = faces.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("size")).agg(F.count("*").alias("n"))
    return sizes.agg(F.max(F.struct("n", "size")).alias("m")).select(F.col("m.size").alias("size"))


def boxes_of_cluster(images: DataFrame, faces: str, cluster: int) -> DataFrame:
    """Images with only those of their faces that are in ``cluster``."""
    return images.withColumn(faces, F.filter(faces, lambda f: f["cluster"] == cluster))


def review(members: DataFrame, confidences: DataFrame, photo: str, cluster: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, noise, totals) of a review: a row for each cluster, the photos in none, and the counts of all."""
    real = members.where(F.col(cluster) != NOISE).select(photo, cluster).distinct()
    rows = real.groupBy(cluster).agg(F.count("*").alias("photos"), F.min(photo).alias("cover")).join(confidences, cluster, "left")
    noise = members.select(photo).distinct().join(real.select(photo), photo, "left_anti")
    totals = members.agg(F.count_distinct(photo).alias("all_photos")).crossJoin(real.agg(F.count_distinct(photo).alias("clustered"), F.count_distinct(cluster).alias("clusters")))
    return rows, noise, totals.withColumn("noise", F.col("all_photos") - F.col("clustered"))


# -- caches ---------------------------------------------------------------------


def cache_stats(cache: DataFrame, path: str) -> DataFrame:
    """(images, faces) of the cache."""
    return cache.agg(F.count_distinct(path).alias("images"), F.count("*").alias("faces"))


def cache_size(entries: DataFrame, size: str) -> DataFrame:
    """(entries, megabytes), two decimals."""
    return entries.agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum(size), F.lit(0)) / (1024 * 1024), 2).alias("megabytes"))


def newest(entries: DataFrame, accessed: str, key: str, keep: int = 500) -> DataFrame:
    """The entries that a small first tier holds: the ``keep`` last accessed."""
    return entries.orderBy(F.desc(accessed), F.desc(key)).limit(keep)


def touched(entries: DataFrame, wanted: DataFrame, key: str, accessed: str, now: Column) -> DataFrame:
    """Entries with the access time of those that were asked for set to ``now``."""
    asked = wanted.select(key).distinct().withColumn("_asked", F.lit(True))
    return entries.join(asked, key, "left").withColumn(accessed, F.when(F.col("_asked"), now).otherwise(F.col(accessed))).select(*entries.columns)


# -- corrections, libraries, prototypes, jobs -------------------------------------


def record_corrections(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with new corrections, whose ids go on from the largest one; ``rows`` have ``seq``, their order from 1."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    return log.unionByName(rows.crossJoin(F.broadcast(last)).withColumn("id", F.col("seq") + F.col("_last")).select(*log.columns))


def adaption_stats(log: DataFrame, action: str) -> DataFrame:
    """(merges, splits, total, split_ratio) of the corrections that move the threshold."""
    merges, splits = (F.count(F.when(F.col(action) == a, 1)) for a in ("merge", "split"))
    rows = log.agg(merges.alias("merges"), splits.alias("splits")).withColumn("total", F.col("merges") + F.col("splits"))
    return rows.withColumn("split_ratio", F.when(F.col("total") > 0, F.round(F.col("splits") / F.col("total"), 6)).otherwise(0.0))


#: Fields of a library that an update may change.
CHANGEABLE = ["name", "path", "photo_count", "last_opened_at"]


def library_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with a new version of each changed library; only ``CHANGEABLE`` fields that are given (not null) change.

    A change of a library that is not there, or was deleted, does nothing. Of several changes of one library each field
    takes the largest value given, so there is one new version.
    """
    now = latest(versions, ["library_id"], [F.desc("version")]).where(~F.col("deleted"))
    fields = [c for c in CHANGEABLE if c in changes.columns]
    given = changes.groupBy("library_id").agg(*[F.max(c).alias(f"_{c}") for c in fields]) if fields else changes.select("library_id").distinct()
    made = now.join(given, "library_id")
    for c in CHANGEABLE:
        if f"_{c}" in made.columns:
            made = made.withColumn(c, F.coalesce(f"_{c}", c))
    return versions.unionByName(made.withColumn("version", F.col("version") + 1).select(*versions.columns))


def deleted_libraries(versions: DataFrame, gone: list) -> DataFrame:
    """The log with a last, deleted version of these libraries."""
    now = latest(versions, ["library_id"], [F.desc("version")]).where(F.col("library_id").isin(gone))
    return versions.unionByName(now.withColumn("version", F.col("version") + 1).withColumn("deleted", F.lit(True)).select(*versions.columns))


def prototypes_as_json(prototypes: DataFrame, label: str) -> DataFrame:
    """(label, json) of prototypes, for a store of text."""
    return prototypes.select(label, F.to_json(F.struct(*[c for c in prototypes.columns if c != label])).alias("json"))


def prototypes_from_json(rows: DataFrame, label: str) -> DataFrame:
    """The prototypes that ``prototypes_as_json`` wrote."""
    kind = "centroid array<double>, member_count long, total_weight double"
    return rows.select(label, F.from_json("json", kind).alias("p")).select(label, "p.*")


def phase_state(log: DataFrame, job: str, phase: str, at: str) -> DataFrame:
    """(job, phases, last_phase, last_at): how far each job came, from the log of its phases."""
    return log.groupBy(job).agg(F.count_distinct(phase).alias("phases"), F.max_by(phase, F.struct(at, phase)).alias("last_phase"), F.max(at).alias("last_at"))


def batches(queue: DataFrame, priority: str, submitted: str, key: str, size: int = 16) -> DataFrame:
    """Adds ``batch``: requests in order of urgency and submission, ``size`` to a batch, within each hour of submission.

    An hour bounds what is put in order together, as a request waits no longer than that.
    """
    hour = F.date_trunc("hour", F.col(submitted))
    order = Window.partitionBy("_hour").orderBy(priority, submitted, key)
    return queue.withColumn("_hour", hour).withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int")).drop("_hour")


# -- small columns ----------------------------------------------------------------


def listed(text: Column, kind: str = "string") -> Column:
    """The parts of a comma-separated text, trimmed, without empty ones and, for numbers, without what is none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.try_cast(kind)), lambda p: p.isNotNull())


def below(path: Column, root: str) -> Column:
    """Whether a path, with its ``.`` and ``..`` worked out, is ``root`` or lies under it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    whole = F.concat(F.lit("/"), F.array_join(clean, "/"), F.lit("/"))
    return F.coalesce(path.startswith("/") & whole.startswith(root.rstrip("/") + "/"), F.lit(False))


def short_id(text: Column) -> Column:
    """Eight characters of a given or random id."""
    return F.substring(F.replace(text, F.lit("-"), F.lit("")), 1, 8)
