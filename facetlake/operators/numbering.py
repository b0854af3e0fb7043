"""Gapless numbers in an order, without sorting all rows in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir names no folder that the executors of {master or 'this session'} share")
        named = "file://" + tempfile.mkdtemp(prefix="facetlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def numbered_in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``keys``, which should tell all rows apart.

    Rows are dealt into ranges, counted from the start of their range, and shifted by
    the sizes of the ranges before; there are as many ranges as shuffle partitions.
    """
    place = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    place = place.withColumn("_range", F.shiftright("_m", 33))
    sizes = place.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.col("_m") - F.shiftleft("_range", 33)
    return place.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + inner).cast("long")).drop("_m", "_range", "_start")
