"""Clustering anew when a stream has brought enough new faces, and label tables in versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from facetlake.operators.clusters import drift, named


def counter_updates(faces: DataFrame, library: str, least: int = 100, many: int = 5000) -> DataFrame:
    """(library, total, fresh, due) of the libraries that a micro-batch touches.

    ``fresh`` counts the faces since the last time that a library was due; it is due with ``many`` of them and ``least``
    in all, once for a micro-batch however many come with it. Faces are counted where they are read, so a library that
    has most of them sends its state few rows. A null library is a library of its own.
    """
    kind = faces.schema[library].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("library").aggregate([([], "count_all")])
            yield from sums.select(["library", "count_all"]).rename_columns(["library", "n"]).to_batches()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, fresh = state.get if state.exists else (0, 0)
        for pdf in batches:
            n = int(pdf["n"].sum())
            total, fresh = total + n, fresh + n
        due = total >= least and fresh >= many
        fresh = 0 if due else fresh
        state.update((total, fresh))
        yield pd.DataFrame({"library": [key[0]], "total": [total], "fresh": [fresh], "due": [due]})

    rows = faces.select(F.col(library).alias("library")).mapInArrow(counted, f"library {kind}, n long")
    counters = rows.groupBy("library").applyInPandasWithState(
        update, f"library {kind}, total long, fresh long, due boolean", "total long, fresh long", "update", GroupStateTimeout.NoTimeout
    )
    return counters.withColumnRenamed("library", library)


def watch(faces: DataFrame, library: str, rebuild: Callable[[object, str], object], checkpoint: str, least: int = 100, many: int = 5000) -> StreamingQuery:
    """Starts a query that calls ``rebuild(library, stamp)`` for every library that is due.

    The stamp names the query and its micro-batch. A micro-batch whose rebuild fails is done again after a restart, with
    the same stamp, from counters as they were before it; ``LabelVersions`` makes one version of that.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        # At most one row for every ``many`` faces of the micro-batch.
        for (name,) in batch.where("due").select(library).collect():
            rebuild(name, f"{query}:{epoch}")

    counters = counter_updates(faces, library, least, many)
    return counters.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).start()


ENTRY = "number long, stamp string, folder string, faces long, common long, changed long, drift double, new_clusters long"


class LabelVersions:
    """The label tables (id, name) of one library under ``path``; they are written once and never changed.

    A version counts from the moment that its one row of the list of versions is there. Spark moves the file with that
    row into place when the labels are complete, so readers see the old version or the new one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, id_type: str) -> None:
        self.spark, self.path, self.id_col = spark, path, id_col
        self.schema = f"`{id_col}` {id_type}, name string"
        spark.createDataFrame([], ENTRY).write.mode("append").parquet(f"{path}/versions")

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/versions")

    def version(self, number: int | None = None) -> DataFrame:
        """The labels of a version, of the last one by default; none yet is an empty table, an unknown number an error."""
        known = self.entries if number is None else self.entries.where(F.col("number") == number)
        last = known.orderBy(F.desc("number")).first()
        if last is None and number is not None:
            raise KeyError(number)
        return self.spark.createDataFrame([], self.schema) if last is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{last['folder']}")

    def publish(self, labels: DataFrame, stamp: str | None = None, before: DataFrame | None = None) -> int:
        """Writes (id, name) as the next version and returns its number; a stamp that is there already writes nothing.

        The entry tells how far the labels moved against ``before``, the assignments of the moment, or else against the
        last version: the share of common ids whose name changed, and the names that are new.
        """
        stamp = stamp or uuid.uuid4().hex
        same = self.entries.where(F.col("stamp") == stamp).first()
        if same is not None:
            return same["number"]
        number = (self.entries.agg(F.max("number")).first()[0] or 0) + 1
        old = self.version() if before is None else before.select(self.id_col, "name")
        folder = f"labels-{number}-{uuid.uuid4().hex}"
        labels.select(self.id_col, "name").write.parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        entry = drift(old, made, self.id_col, "name").crossJoin(made.agg(F.count("*").alias("faces")))
        entry = entry.withColumns({"number": F.lit(number).cast("long"), "stamp": F.lit(stamp), "folder": F.lit(folder)})
        entry.select(self.entries.columns).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return number


def reoptimise(
    versions: LabelVersions, faces: DataFrame, cluster: Callable[[DataFrame], DataFrame], stamp: str | None = None, before: DataFrame | None = None
) -> int:
    """Clusters all ``faces`` anew with ``cluster`` (to id and ``label``) and publishes the names; returns the version's number."""
    return versions.publish(named(cluster(faces), versions.id_col, "label"), stamp, before)
