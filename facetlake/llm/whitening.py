"""Whitening of vectors by a covariance that is made of tiles.

Entries become integers, so the list of distinct vectors, its size and its sums are exact. The list
is cut into blocks of rows, and each of them into blocks of columns; column blocks of a row block meet
by its number, every pair is multiplied, and products are summed for each tile. The driver assembles
the matrix of ``D * D`` doubles, whose size depends on the vectors' dimensions and not on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Scaled entries beyond stand here; all integers up to it are doubles as well.
MOST = float(1 << 52)
#: Columns of a tile, rows of a block, and doubles of unsent tiles that a task holds.
TILE, BLOCK_ROWS, HELD = 32, 4096, 1 << 22


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def fit_columns(vec: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift for each entry, as longs."""
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))).cast("long") + F.lit(shift).cast("long")
    return F.transform(vec, whole)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension; halves of 32 bits keep a batch's sums within longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high]), pa.array([low])], names=["n", "high", "low"])

    parts = fit.mapInArrow(run, "n long, high array<long>, low array<long>")
    each = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("d", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = each.groupBy("d").agg(F.sum("n").alias("n"), exact("s.high").alias("high"), exact("s.low").alias("low")).orderBy("d").collect()
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def _narrow(x: np.ndarray) -> bytes:
    """The bytes of integers in the narrowest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes, rows: int) -> np.ndarray:
    """``_narrow`` read back as doubles, rows first; the width of a column block is stored before them."""
    width = int.from_bytes(data[:4], "little")
    kind = np.dtype(f"i{(len(data) - 4) // (rows * width)}")
    return np.frombuffer(data, kind, offset=4).reshape(rows, width).astype(np.float64)


def column_blocks(fit: DataFrame, centre: np.ndarray, dims: int, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_block, col, n, data): the entries less ``centre``, in blocks of at most ``block_rows`` rows and ``tile`` columns."""
    sent = fit.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                x = _matrix(batch.slice(at, block_rows).column(0), dims) - sent.value
                cols = [x[:, c : c + tile] for c in range(0, dims, tile)]
                data = [c.shape[1].to_bytes(4, "little") + _narrow(c) for c in cols]
                k = len(cols)
                yield pa.RecordBatch.from_arrays([pa.array([number] * k), pa.array(np.arange(k, dtype=np.int32)), pa.array([len(x)] * k), pa.array(data, pa.binary())], names=["row_block", "col", "n", "data"])
                number += 1

    return fit.mapInArrow(run, "row_block long, col int, n long, data binary")


def covariance(fit: DataFrame, n: int, centre: np.ndarray, rest: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance of ``fit`` (one column of vectors) by tiles; the mean is ``centre`` (integers) and ``rest`` (below 1)."""
    dims = len(centre)
    blocks = stored(column_blocks(fit, centre, dims, tile, block_rows), "columns")
    right = blocks.select("row_block", F.col("col").alias("col2"), F.col("data").alias("data2"))
    pairs = blocks.join(right.hint("shuffle_hash"), "row_block").where("col <= col2").select("col", "col2", "n", "data", "data2")
    sent = fit.sparkSession.sparkContext.broadcast(rest)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            kinds = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
            batch = pa.RecordBatch.from_arrays([*kinds, pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["a", "b", "values"])
            held.clear()
            return batch

        for batch in batches:
            for a, b, rows, left, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                side = lambda k, data: _wide(data, rows) - sent.value[k * tile : (k + 1) * tile]  # noqa: E731, B023
                product = side(a, left).T @ side(b, other)
                held[a, b] = held[a, b] + product if (a, b) in held else product
            if sum(m.size for m in held.values()) > HELD:
                yield out()
        if held:
            yield out()

    tiles = pairs.mapInArrow(multiply, "a int, b int, values array<double>")
    summed = tiles.select("a", "b", F.posexplode("values").alias("place", "v")).groupBy("a", "b", "place").agg(F.sum("v").alias("v"))
    out = np.zeros((dims, dims))
    for r in summed.toLocalIterator():
        width = min(tile, dims - r.b * tile)
        i, j = r.a * tile + r.place // width, r.b * tile + r.place % width
        out[i, j] = out[j, i] = r.v / n
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those without variance beyond rounding are left out."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    some = e > max(e[0], 0) * len(e) * np.finfo(float).eps
    return e[some][:most], u[:, some][:, :most]


def _centred(x: np.ndarray, centre: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - centre).astype(np.float64) - rest


def identity_error(fit: DataFrame, n: int, centre: np.ndarray, rest: np.ndarray, project: np.ndarray) -> float:
    """The largest absolute entry of the covariance of ``fit`` projected, less the identity."""
    k, dims = project.shape[1], len(centre)
    sent = fit.sparkSession.sparkContext.broadcast((centre, rest, project))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r, p = sent.value
        total = np.zeros(k)
        for batch in batches:
            total += (_centred(_matrix(batch.column(0), dims), c, r) @ p).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

    def summed(f, size: int) -> np.ndarray:
        each = fit.mapInArrow(f, "s array<double>").select(F.posexplode("s").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("v"))
        out = np.zeros(size)
        for r in each.collect():
            out[r.d] = r.v
        return out

    middle = fit.sparkSession.sparkContext.broadcast(summed(mean, k) / n)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r, p = sent.value
        total = np.zeros((k, k))
        for batch in batches:
            w = _centred(_matrix(batch.column(0), dims), c, r) @ p - middle.value
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["s"])

    return float(np.abs(summed(products, k * k).reshape(k, k) / n - np.eye(k)).max(initial=0))


def _deviations(d: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * d - rest)^2, exact; null where a long cannot hold one."""
    top = n * int(np.abs(d).max(initial=0)) + max((abs(r) for r in rest), default=0)
    kind = np.int64 if d.shape[1] * top * top < 1 << 62 else object
    gap = d.astype(kind) * n - np.array(rest, kind)
    return [v if v < 1 << 63 else None for v in (gap * gap).sum(1).tolist()]


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
    scale: int = 64, shift: int = 1_000_000, tile: int = TILE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row for each vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    The entries x are ``floor(scale * c) + shift``; the fit list is each distinct x vector once, n of them with sums S.
    Rows whose vector is null or holds a null or non-finite entry are left out. Repeated rows stay, and count once in the
    fit. Shorter vectors are filled up with zeros to the longest. Scaled entries beyond ``2**52`` stand there. A deviation
    that no long can hold is null. Directions without variance cannot be whitened and are left out, so equal vectors, a
    single row, an empty table or empty vectors give no rows. Null ids are kept as they are, further columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    good = vectors.where(F.col(vec_col).isNotNull()).where(finite)
    rows = stored(good.select(F.col(id_col).alias("id"), fit_columns(F.col(vec_col), scale, shift).alias("x")), "entries")
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    dims = sizes.most or 0
    if not dims:
        return spark.createDataFrame([], shape)
    if sizes.least < dims:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x"))))
    fit = stored(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit, dims)
    whole, left = [s // n for s in sums], [s % n for s in sums]
    centre, rest = np.array(whole, np.int64), np.array([float(Fraction(r, n)) for r in left])
    v = covariance(fit, n, centre, rest, tile, block_rows)
    e, u = principal(v, components)
    if not len(e):
        return spark.createDataFrame([], shape)
    project = u / np.sqrt(e)
    explained, error, k = e / np.trace(v), identity_error(fit, n, centre, rest, project), len(e)
    sent = spark.sparkContext.broadcast((centre, rest, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r, p = sent.value
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                piece = batch.slice(at, block_rows)
                x = _matrix(piece.column(1), dims)
                w = _centred(x, c, r) @ p
                each = pa.array(np.repeat(np.arange(len(x)), k))
                away = pa.array(_deviations(x - c, n, left), pa.int64())
                numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                full = lambda value, t: pa.array(np.full(len(x) * k, value, t))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(each), pa.array(numbers), full(n, np.int64), away.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), full(error, np.float64)],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "x").mapInArrow(run, shape)
