"""Similarity search over vectors: one query, pages of it, and blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions.vectors import composite, cosine, present, unit


#: Rows of a batch and queries that are compared at once: a task's scores stay as large, however many rows and queries there are.
ROWS, QUERIES = 2048, 1024


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(batch), ROWS):
        yield batch.slice(lo, ROWS)


def blocks(queries: int) -> Iterator[np.ndarray]:
    for lo in range(0, queries, QUERIES):
        yield np.arange(lo, min(lo + QUERIES, queries))


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a column, all of one size and without nulls, in double precision."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), size)


class Best:
    """The ``k`` best (score, id, ...) of each query, of equal scores the smaller ids; a query does not find itself."""

    def __init__(self, ids: list, k: int):
        self.ids, self.k = ids, k
        self.found: list[list[tuple]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def worth(self, at: np.ndarray, scores: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(query's row, column) of the scores (queries x rows) that can be among the best of the queries ``at``, by query."""
        floor = self.least[at]
        fresh = np.flatnonzero(np.isneginf(floor))
        if len(fresh) and scores.shape[1] > self.k + 1:
            floor[fresh] = np.partition(scores[fresh], -(self.k + 1), axis=1)[:, -(self.k + 1)]
        return np.nonzero(scores >= (floor - slack)[:, None])

    def offer(self, at: np.ndarray, scores: np.ndarray, own: list) -> None:
        i, j = self.worth(at, scores)
        self.add(at[i], scores[i, j], j, own)

    def add(self, at: np.ndarray, scores: np.ndarray, j: np.ndarray, *columns: list) -> None:
        """``scores`` of the queries ``at``, which are in order, with the rows ``j`` of ``columns``; the first of these are ids."""
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)) if len(at) else np.zeros(0, int)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q = int(at[lo])
            new = [(-s, *(c[r] for c in columns)) for s, r in zip(scores[lo:hi].tolist(), j[lo:hi].tolist(), strict=True)]
            rows = sorted([r for r in new if r[1] != self.ids[q]] + self.found[q], key=lambda r: r[:2])[: self.k]
            self.found[q] = rows
            if len(rows) == self.k:
                self.least[q] = -rows[-1][0]

    def rows(self) -> list[tuple]:
        """(query id, score, id, ...)"""
        return [(q, -s, *more) for q, found in zip(self.ids, self.found, strict=True) for s, *more in found]


def search(
    corpus: DataFrame,
    query: list[float],
    id_col: str,
    vec_col: str,
    top_k: int = 50,
    min_score: float = 0.4,
    exclude: object = None,
    where: Column | None = None,
    quality: Column | None = None,
) -> DataFrame:
    """The ``top_k`` rows most similar to one vector, with ``similarity`` (4 decimals) and ``rank``.

    The query is a literal, so the plan is scan, project, filter and take-ordered:
    no shuffle of the corpus. Ties go to higher quality, then to the smaller id.
    Vectors of another size are left out.
    """
    rows = corpus.where(F.size(vec_col) == len(query))
    if exclude is not None:
        rows = rows.where(F.col(id_col) != exclude)
    if where is not None:
        rows = rows.where(where)
    rows = rows.withColumn("similarity", F.round(cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])), 4))
    order = [F.desc("similarity"), *([F.desc(quality)] if quality is not None else []), F.col(id_col)]
    top = rows.where(F.col("similarity") >= min_score).orderBy(*order).limit(top_k)
    # At most top_k rows: one task numbers them.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page_of(results: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of ranked results with ``total``, the number of results before paging."""
    counted = results.withColumn("total", F.count("*").over(Window.partitionBy()))
    return counted.where((F.col("rank") > (page - 1) * page_size) & (F.col("rank") <= page * page_size))


def vector_of(corpus: DataFrame, id_col: str, vec_col: str, key: object) -> list[float]:
    """The vector of one id; an unknown id is an error."""
    row = corpus.where(F.col(id_col) == key).select(vec_col).first()
    if row is None:
        raise KeyError(key)
    return list(row[0])


def top_neighbours(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, k: int, block_rows: int = 20_000, scale: bool = True) -> DataFrame:
    """(query_id, id_col, similarity, rank): for each query its ``k`` most similar rows of ``corpus``, itself left out.

    A stated query set against all rows: queries are gathered in blocks of
    ``block_rows`` and sent to the tasks; each task keeps the best ``k`` of its own
    rows for every query, and those few meet in one ranking by query. Without ``scale``
    vectors are compared as they are, by their inner product. Rows without a vector, with a null in it, or of another
    size than the first query's are left out, of the queries as of the corpus.
    """
    first = None
    ready = _rows_to_unit if scale else np.asarray
    some = queries.where(present(F.col(vec_col)))
    first_row = some.select(F.size(vec_col)).first()
    size = first_row[0] if first_row else 0
    corpus = corpus.where(present(F.col(vec_col), size))
    gathered = some.where(F.size(vec_col) == size).select(F.col(id_col).alias("id"), vec_col).orderBy("id").toArrow()
    kind = corpus.schema[id_col].dataType.simpleString()
    for lo in range(0, max(len(gathered), 1), block_rows):
        part = gathered.slice(lo, block_rows)
        ids = part.column(0).to_pylist()
        matrix = np.array(part.column(1).to_pylist(), np.float64).reshape(len(ids), size)
        sent = corpus.sparkSession.sparkContext.broadcast((ids, ready(matrix)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            best = Best(query_ids, k)
            for batch in batches:
                for part in slices(batch):
                    own, v = part.column(0).to_pylist(), ready(matrix_of(part.column(1), size))
                    for at in blocks(len(query_ids)):
                        best.offer(at, np.round(q[at] @ v.T, 6), own)
            flat = best.rows()
            if flat:
                a, s, b = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float64())], names=["query_id", id_col, "similarity"])

        found = corpus.select(id_col, vec_col).mapInArrow(run, f"query_id {kind}, `{id_col}` {kind}, similarity double")
        first = found if first is None else first.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blended_neighbours(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, head_col: str, k: int, weight: float = 0.2) -> DataFrame:
    """(query_id, id_col, similarity, rank) by 1 - the blended distance of faces and heads.

    Where one of two faces has no head (null), their faces alone count. So queries and corpus are
    parted by whether they have one, and each part is a search of its own.
    """
    alone = lambda rows: rows.select(id_col, unit(F.col(vec_col)).alias("_v"))
    both = lambda rows: rows.where(F.col(head_col).isNotNull()).select(id_col, composite(F.col(vec_col), F.col(head_col), weight).alias("_v"))
    headed, bare = (lambda rows: rows.where(F.col(head_col).isNotNull())), (lambda rows: rows.where(F.col(head_col).isNull()))
    parts = [(both(queries), both(corpus)), (alone(headed(queries)), alone(bare(corpus))), (alone(bare(queries)), alone(corpus))]
    found = [top_neighbours(q, c, id_col, "_v", k, scale=False).drop("rank") for q, c in parts]
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rows_to_unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10) if m.size else m


def active(index: DataFrame, tombstones: DataFrame, id_col: str) -> DataFrame:
    """Rows of an index that are not marked as deleted."""
    return index.join(tombstones.select(id_col).distinct(), id_col, "left_anti")


def needs_rebuild(total: int, deleted: int, percent: int = 10) -> bool:
    return deleted * 100 > total * percent
