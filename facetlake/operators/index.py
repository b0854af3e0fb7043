"""An inverted-file index of unit vectors: cells around k-means centres, searched a few cells at a time.

Centres are fitted on a bounded sample; every row is in the index, written in
one folder for each cell. A search reads the cells nearest to its queries only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlake.functions.vectors import present, unit

from .search import Best, active, blocks, matrix_of, needs_rebuild, slices


def fit_cells(corpus: DataFrame, id_col: str, vec_col: str, cells: int, sample_rows: int = 50_000, seed: int = 1) -> np.ndarray:
    """Centres (cells x dimensions) fitted on about ``sample_rows`` rows, chosen by the hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample_rows / max(corpus.count(), 1))
    picked = corpus.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = picked.select(array_to_vector(unit(F.col(vec_col))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(rows)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-10)


def with_cells(rows: DataFrame, centres: np.ndarray, id_col: str, vec_col: str, cells: int = 1) -> DataFrame:
    """(id_col, v, cell): unit vectors with their ``cells`` nearest cells, a row for each; rows without a whole vector of the centres' size are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if not len(batch):
                continue
            v = matrix_of(batch.column(1), c.shape[1])
            order = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[id_col, "v", "cells"])

    whole = rows.where(present(F.col(vec_col), centres.shape[1]))
    made = whole.select(id_col, unit(F.col(vec_col)).alias("v")).mapInArrow(run, f"`{id_col}` {kind}, v array<double>, cells array<int>")
    return made.select(id_col, "v", F.explode("cells").alias("cell"))


def write_index(corpus: DataFrame, centres: np.ndarray, id_col: str, vec_col: str, path: str) -> None:
    """All rows, in a folder for each cell."""
    _write_rows(corpus, centres, id_col, vec_col, path, 0)


def _write_rows(rows: DataFrame, centres: np.ndarray, id_col: str, vec_col: str, path: str, batch: int) -> None:
    placed = with_cells(rows, centres, id_col, vec_col).withColumn("batch", F.lit(batch)).withColumn("place", F.monotonically_increasing_id())
    placed.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(8))).write.mode("append").partitionBy("cell").parquet(path)


def search_index(spark: SparkSession, path: str, queries: DataFrame, centres: np.ndarray, id_col: str, vec_col: str, k: int, probes: int, deleted: DataFrame | None = None) -> DataFrame:
    """(query_id, id_col, similarity, rank): the best ``k`` among the ``probes`` cells nearest to each query.

    The queries are a stated, gathered set. The cells that none of them needs are
    pruned from the scan. Ids in ``deleted`` are not found.
    """
    asked = with_cells(queries, centres, id_col, vec_col, probes).toArrow()
    by_cell: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    cell = np.array(asked.column("cell").to_pylist())
    ids, v = asked.column(0).to_pylist(), matrix_of(asked.column(1).combine_chunks(), centres.shape[1])
    names = sorted(set(ids))
    place = {x: i for i, x in enumerate(names)}
    places = np.array([place[x] for x in ids], np.int64)
    for c in sorted(set(cell.tolist())):
        at = np.flatnonzero(cell == c)
        at = at[np.argsort(places[at], kind="stable")]
        by_cell[c] = places[at], v[at]
    sent = spark.sparkContext.broadcast((names, by_cell))
    rows = spark.read.parquet(path).where(F.col("cell").isin(list(by_cell)))
    if deleted is not None:
        rows = active(rows, deleted, id_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_cell = sent.value
        best = Best(names, k)
        for whole in batches:
            for batch in slices(whole):
                cells, own = np.array(batch.column(2).to_pylist(), np.int64), batch.column(0).to_pylist()
                m = matrix_of(batch.column(1), centres.shape[1])
                for c in np.unique(cells):
                    at = np.flatnonzero(cells == c)
                    asked, q = by_cell[int(c)]
                    here = [own[i] for i in at]
                    for some in blocks(len(asked)):
                        best.offer(asked[some], np.round(q[some] @ m[at].T, 6), here)
        flat = best.rows()
        if flat:
            a, s, b = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float64())], names=["query_id", id_col, "similarity"])

    found = rows.select(id_col, "v", "cell").mapInArrow(run, f"query_id {kind}, `{id_col}` {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -- an index as a folder: rows by cell, centres, deleted ids -----------------------


@dataclass
class VectorIndex:
    """An index that was opened: its folder, column of ids, centres and kind of ids.

    Rows are only ever appended, each with its batch. An id that is added again is
    found with all its vectors, and ``vector_of`` gives the last one. Deleted ids are
    marked, and leave with ``rebuild``. One writer at a time is assumed.
    """

    spark: SparkSession
    path: str
    id_col: str
    centres: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def deleted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/deleted")

    def add(self, rows: DataFrame, vec_col: str) -> None:
        batch = self.rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] + 1
        _write_rows(rows, self.centres, self.id_col, vec_col, f"{self.path}/rows", batch)

    def soft_delete(self, ids: DataFrame) -> None:
        """Marks those ids that are in the index and not marked yet."""
        known = ids.select(self.id_col).distinct().join(self.rows.select(self.id_col), self.id_col, "left_semi")
        known.join(self.deleted, self.id_col, "left_anti").write.mode("append").parquet(f"{self.path}/deleted")

    def counts(self) -> tuple[int, int, int]:
        """(total, active, deleted): vectors, vectors that are not marked, and marked ids."""
        return self.rows.count(), active(self.rows, self.deleted, self.id_col).count(), self.deleted.count()

    def needs_rebuild(self) -> bool:
        """Whether more than a tenth is marked."""
        return needs_rebuild(self.rows.count(), self.deleted.count())

    def vector_of(self, key: object) -> list[float]:
        """The last vector of an id; an unknown id is an error."""
        row = self.rows.where(F.col(self.id_col) == key).orderBy(F.desc("batch"), F.desc("place")).select("v").first()
        if row is None:
            raise KeyError(key)
        return list(row[0])

    def search(self, queries: DataFrame, vec_col: str, k: int, probes: int = 8) -> DataFrame:
        """(query_id, id, similarity, rank) among the ``probes`` nearest cells; an index of one cell is searched whole."""
        return search_index(self.spark, f"{self.path}/rows", queries, self.centres, self.id_col, vec_col, k, min(probes, len(self.centres)), self.deleted)

    def rebuild(self, path: str, cells: int = 0) -> VectorIndex:
        """A new index in another folder, of the rows that are not marked, with centres fitted anew."""
        return create(active(self.rows, self.deleted, self.id_col).select(self.id_col, "v"), self.id_col, "v", path, cells)


def create(corpus: DataFrame, id_col: str, vec_col: str, path: str, cells: int = 0, sample_rows: int = 50_000) -> VectorIndex:
    """Writes an index. It has ``cells`` cells where there are at least ten rows for each, else one: a flat index."""
    spark = corpus.sparkSession
    if cells > 0 and corpus.limit(10 * cells).count() == 10 * cells:
        centres = fit_cells(corpus, id_col, vec_col, cells, sample_rows)
    else:
        first = corpus.select(F.size(vec_col)).first()
        centres = np.zeros((1, first[0] if first else 1))
    _write_rows(corpus, centres, id_col, vec_col, f"{path}/rows", 0)
    corpus.select(id_col).limit(0).write.parquet(f"{path}/deleted")
    saved = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(saved, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return VectorIndex(spark, path, id_col, centres)


def load(spark: SparkSession, path: str, id_col: str) -> VectorIndex:
    """Opens an index that ``create`` wrote."""
    saved = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return VectorIndex(spark, path, id_col, np.array([r["centre"] for r in saved]))
