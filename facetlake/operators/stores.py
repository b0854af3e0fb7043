"""Tables that are written again and again: caches, metadata, tags, corrections.

Plain Parquet has no update in place: each operation gives the new table as a
frame, to be written beside the old one and swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``rows`` replace those of ``table`` with the same keys; of rows that repeat a key the first by ``order`` counts, or any one without it."""
    once = latest(rows, keys, order) if order else rows.dropDuplicates(keys)
    return table.join(once.select(*keys), keys, "left_anti").unionByName(once)


def latest(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cache_lookup(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached rows whose path, fingerprint and model settings all agree, and what has to be computed."""
    return cache.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def cache_store(cache: DataFrame, faces: DataFrame, path: str, vec_col: str) -> DataFrame:
    """All cached faces of the given paths are replaced; faces without a vector are not kept."""
    return cache.join(faces.select(path).distinct(), path, "left_anti").unionByName(faces.where(F.col(vec_col).isNotNull()))


def update_clusters(table: DataFrame, changes: DataFrame, key: str, cluster: str) -> DataFrame:
    """New clusters by key; a change to null counts as a change, and of several changes of a key the largest cluster is taken."""
    once = changes.groupBy(key).agg(F.max(cluster).alias(cluster))
    new = once.select(key, F.col(cluster).alias("_new"), F.lit(True).alias("_given"))
    return table.join(new, key, "left").withColumn(cluster, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(cluster))).select(*table.columns)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def evict(entries: DataFrame, size: str, accessed: str, key: str, limit: int, keep: float = 0.8) -> DataFrame:
    """The entries that stay: with more than ``limit`` bytes in all, the oldest go until at most ``keep`` of it is left.

    Sizes are first summed by hour of access, so that only the hour in which the
    line falls is ordered entry by entry.
    """
    hour = F.date_trunc("hour", F.col(accessed))
    hours = entries.groupBy(hour.alias("_hour")).agg(F.sum(size).alias("_size"))
    newer = Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_size").over(Window.partitionBy())
    hours = hours.select("_hour", F.coalesce(F.sum("_size").over(newer), F.lit(0)).alias("_before"), total.alias("_total"))
    rows = entries.withColumn("_hour", hour).join(hours, "_hour")
    inner = Window.partitionBy("_hour").orderBy(F.desc(accessed), F.desc(key))
    held = F.col("_before") + F.sum(size).over(inner)
    return rows.withColumn("_held", held).where((F.col("_total") <= limit) | (F.col("_held") <= limit * keep)).select(*entries.columns)


def tag_index(image_tags: DataFrame, image: str, tags: str, scores: str | None = None) -> DataFrame:
    """(tag, image, score), derived from the tags, so that no stale rows stay."""
    value = F.coalesce(F.element_at(F.col(scores), F.col("tag")), F.lit(1.0)) if scores else F.lit(1.0)
    return image_tags.select(F.explode(tags).alias("tag"), image, *([scores] if scores else [])).select("tag", image, value.alias("score"))


def search_tag(index: DataFrame, tag: str, image: str, min_score: float = 0.0, limit: int = 100) -> DataFrame:
    return index.where((F.col("tag") == tag) & (F.col("score") >= min_score)).orderBy(F.desc("score"), image).limit(limit)


def search_any_tag(index: DataFrame, tags: list[str], image: str, min_score: float = 0.0, limit: int = 100) -> DataFrame:
    """Images with any of the tags by their highest score."""
    hits = index.where(F.col("tag").isin(tags) & (F.col("score") >= min_score)).groupBy(image).agg(F.max("score").alias("score"))
    return hits.orderBy(F.desc("score"), image).limit(limit)


def tag_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def tags_by_category(image_tags: DataFrame, image: str, category: str, tags: str, stamp: str | None = None) -> DataFrame:
    """(image, categories): a map from category to tags. Of rows that repeat a category the newest by ``stamp`` counts, else the last in order."""
    last = F.max(F.struct(*([stamp] if stamp else []), tags)).getField(tags).alias(tags)
    image_tags = image_tags.groupBy(image, category).agg(last)
    entries = F.array_sort(F.collect_list(F.struct(category, tags)))
    return image_tags.groupBy(image).agg(F.map_from_entries(entries).alias("categories"))
