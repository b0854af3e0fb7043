"""Registered queries that run streams over whole tables and keep versions of labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators.numbering import shared_dir
from facetlake.sources.tables import table
from facetlake.streaming.reoptimise import LabelVersions, counter_updates

from .registry import query


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/facetlake/{what}-{uuid.uuid4().hex}"


@query(
    """SELECT label, count(*) AS total, CASE WHEN count(*) >= 40 THEN 0 ELSE count(*) END AS fresh, count(*) >= 40 AS due
    FROM embeddings GROUP BY label"""
)
def optimiser_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream that reads all embeddings in one micro-batch; each label is a library."""
    schema = table(spark, sf_dir, "embeddings").schema
    # A pattern, since the table may be a file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    out = _fresh(spark, "counters")
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    counters = counter_updates(stream, "label", 20, 40)
    q = counters.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("label int, total long, fresh long, due boolean").parquet(f"{out}/epoch=*")


@query(
    """WITH a AS (SELECT vec_id, 'cluster_' || label AS name FROM embeddings),
    b AS (SELECT vec_id, 'cluster_' || CASE WHEN vec_id % 7 = 0 THEN label + 1000 ELSE label END AS name FROM embeddings)
    SELECT 1::BIGINT AS number, count(*) AS faces, 0::BIGINT AS common, 0::BIGINT AS changed, 0.0::DOUBLE AS drift, count(DISTINCT name) AS new_clusters FROM a
    UNION ALL SELECT 2, count(*), count(*), count(*) FILTER (a.name <> b.name), round(count(*) FILTER (a.name <> b.name) / count(*), 6),
    count(DISTINCT b.name) FILTER (b.name NOT IN (SELECT name FROM a)) FROM a JOIN b USING (vec_id)"""
)
def label_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the labels of all embeddings, the second with a seventh of them moved, as the list of versions tells them."""
    rows = table(spark, sf_dir, "embeddings")
    versions = LabelVersions(spark, _fresh(spark, "versions"), "vec_id", "long")
    moved = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1000).otherwise(F.col("label"))
    for label in (F.col("label"), moved):
        versions.publish(rows.select("vec_id", F.concat(F.lit("cluster_"), label.cast("string")).alias("name")))
    return versions.entries.select("number", "faces", "common", "changed", "drift", "new_clusters")
