"""Albums: events by time gaps, covers, growth timelines, photos of several people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(photos: DataFrame, owner: str, ts: str, path: str, gap: str = "4 hours") -> DataFrame:
    """Adds ``event_no`` (0, 1, ... for each owner) and ``event_id``: a gap longer than ``gap`` opens an event, an exact one does not."""
    order = Window.partitionBy(owner).orderBy(ts, path)
    fresh = F.when(F.col(ts) - F.lag(ts).over(order) > F.expr(f"INTERVAL {gap}"), 1).otherwise(0)
    numbered = photos.withColumn("_new", fresh).withColumn("event_no", F.sum("_new").over(order).cast("int")).drop("_new")
    return numbered.withColumn("event_id", F.format_string("event_%04d", "event_no"))


def events(numbered: DataFrame, owner: str, ts: str, path: str) -> DataFrame:
    """(owner, event_id, start_time, end_time, photo_count, photo_paths, is_multi_day)."""
    rows = numbered.groupBy(owner, "event_id").agg(
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count("*").alias("photo_count"),
        F.transform(F.array_sort(F.collect_list(F.struct(ts, path))), lambda p: p[path]).alias("photo_paths"),
    )
    return rows.withColumn("is_multi_day", F.to_date("end_time") > F.to_date("start_time"))


def covers(numbered: DataFrame, owner: str, ts: str, path: str, quality: Column) -> DataFrame:
    """(owner, event_id, cover): the photo of the highest quality, the earliest of equals, then the first path; unknown quality counts 0."""
    best = F.min_by(path, F.struct((-F.coalesce(quality, F.lit(0.0))).alias("q"), F.col(ts).alias("t"), F.col(path).alias("p")))
    return numbered.groupBy(owner, "event_id").agg(best.alias("cover"))


def growth_timelines(photos: DataFrame, person: str, ts: str, min_photos: int = 5, min_months: int = 12) -> DataFrame:
    """(person, photos, span_months, has_growth_milestone) of people with enough photos over enough time."""
    agg = photos.groupBy(person).agg(F.count("*").alias("photos"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    days = F.floor((F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / F.lit(86_400_000_000))
    rows = agg.withColumn("months", days / 30.44).withColumn("has_growth_milestone", F.col("months") >= min_months)
    enough = (F.col("photos") >= min_photos) & (F.col("has_growth_milestone") | (F.col("photos") >= 2 * min_photos))
    return rows.where(enough).select(person, "photos", F.round("months", 1).alias("span_months"), "has_growth_milestone")


def with_all_people(memberships: DataFrame, photo: str, person: str, people: list, without: list | None = None) -> DataFrame:
    """Photos on which every one of ``people`` is, and none of ``without``."""
    found = memberships.where(F.col(person).isin(people)).groupBy(photo).agg(F.count_distinct(person).alias("n")).where(F.col("n") == len(set(people))).select(photo)
    if without:
        found = found.join(memberships.where(F.col(person).isin(without)), photo, "left_anti")
    return found


def best_faces(faces: DataFrame, cluster: str, order_col: str, area: Column, score: Column, at_edge: Column) -> DataFrame:
    """One face for each cluster: the highest score off the image's edge and not below a third of the mean area; else the first face."""
    group, every = Window.partitionBy(cluster), Window.partitionBy(cluster).orderBy(order_col)
    rows = faces.withColumn("_area", area).withColumn("_n", F.count("*").over(group)).withColumn("_mean", F.avg("_area").over(group))
    fits = ~at_edge & ((F.col("_n") == 1) | (F.col("_area") >= F.col("_mean") / 3))
    rows = rows.withColumn("_fits", fits).withColumn("_score", F.when(fits, score)).withColumn("_first", F.row_number().over(every))
    order = Window.partitionBy(cluster).orderBy(F.desc_nulls_last("_score"), order_col)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_area", "_n", "_mean", "_fits", "_score", "_first", "_r")
