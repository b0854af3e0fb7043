"""Cutting lineage through the folder that all executors share.

``spark.checkpoint.dir`` is read from the session. Where it is unset a local session
(tests, a laptop) takes a temporary folder; any other session has to name a shared one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. A local session without one gets a folder on its own disk; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir names no folder that the executors of {master or 'this session'} share")
        named = "file://" + tempfile.mkdtemp(prefix="facetlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/facetlake/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Later jobs start from these files, so a lost executor costs only the running
    tasks. The schema is given on reading, which keeps empty results readable.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
