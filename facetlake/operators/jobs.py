"""Queues, checkpoints, corrections and libraries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import latest


def pending(items: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """What has not been completed; a restarted job goes on with these."""
    return items.join(completed.select(key).distinct(), key, "left_anti")


def next_batch(queue: DataFrame, priority: str, submitted: str, size: int = 16) -> DataFrame:
    """The ``size`` most urgent items, in order of submission within a priority."""
    return queue.orderBy(priority, submitted).limit(size)


def corrections(log: DataFrame, action: str | None = None, limit: int = 100) -> DataFrame:
    """The newest corrections, of one action if named."""
    rows = log if action is None else log.where(F.col("action") == action)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def correction_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n"))


def correction_kind(old: Column, new: Column) -> Column:
    """A face moved to no cluster splits, one moved to a cluster merges."""
    return F.when(new == -1, "split").when(old != new, "merge").otherwise("none")


def libraries(versions: DataFrame) -> DataFrame:
    """The present libraries from the log of their versions: the last of each, without deleted ones, the last opened first."""
    now = latest(versions, ["library_id"], [F.desc("version")])
    return now.where(~F.col("deleted")).drop("deleted").orderBy(F.desc("last_opened_at"), "library_id")


def pipeline_totals(images: DataFrame, faces: str, error: str) -> DataFrame:
    """(images, with_faces, faces, errors) of a run."""
    return images.agg(
        F.count("*").alias("images"),
        F.count(F.when(F.col(faces) > 0, 1)).alias("with_faces"),
        F.coalesce(F.sum(faces), F.lit(0)).alias("faces"),
        F.count(error).alias("errors"),
    )


def summed_stats(images: DataFrame, stats: str) -> DataFrame:
    """(name, total): a map column of counters, summed by name."""
    return images.select(F.explode(stats).alias("name", "value")).groupBy("name").agg(F.sum("value").alias("total"))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias(name))
