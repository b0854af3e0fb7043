"""Vectors in packs, one row of a bounded size for many, and a product in which all pairs of packs meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import cut

#: Rows of a pack that are compared at once with another pack, and the most parts that packs are dealt to on one side.
TILE, LEFT_PARTS = 512, 48
#: More than the error of an inner product of unit vectors in single precision.
ROUGH = 1e-5


def packed(rows: DataFrame, kind: str, block_rows: int, numbers: list[str], lists: dict[str, str] | None = None) -> DataFrame:
    """(pack, ids, v, ...): the rows of a partition in their order, at most ``block_rows`` in a pack; vectors and ``numbers`` as bytes of doubles, ``lists`` of a type as arrays."""
    lists = lists or {}
    names = ["ids", "v", *numbers, *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            ids = t.column("id").combine_chunks()
            columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            columns.append(pa.array([np.asarray(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).tobytes()], pa.binary()))
            columns += [pa.array([t.column(c).to_numpy().astype(np.float64).tobytes()], pa.binary()) for c in numbers]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), t.column(c).combine_chunks()) for c in lists]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            while len(held) >= block_rows:
                yield out(held.slice(0, block_rows))
                held = held.slice(block_rows)
        if held is not None and len(held):
            yield out(held)

    shape = ", ".join([f"ids array<{kind}>, v binary", *(f"{c} binary" for c in numbers), *(f"{c} array<{t}>" for c, t in lists.items())])
    made = rows.select("id", "v", *numbers, *lists).mapInArrow(run, shape)
    return cut(made.select(F.monotonically_increasing_id().alias("pack"), *names))


def unpacked(packs: DataFrame, kind: str) -> DataFrame:
    """(id, n, v) of the packs' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, v = batch.column("ids")[i].values, np.frombuffer(batch.column("v")[i].as_py())
                starts = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (len(v) // len(ids)))
                n = np.frombuffer(batch.column("n")[i].as_py()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.ListArray.from_arrays(starts, pa.array(v))], names=["id", "n", "v"])

    return packs.select("ids", "n", "v").mapInArrow(run, f"id {kind}, n long, v array<double>")


def met(left: DataFrame, right: DataFrame, run: Callable, schema: str, where: Column | None = None) -> DataFrame:
    """What ``run`` makes of every pack of ``left`` with every one of ``right``: packs are read again for each other part, not shuffled.

    Arrow batches hold one pair, since a pack is a large row.
    """
    spark = left.sparkSession
    many = left.coalesce(LEFT_PARTS).select(*(F.col(c).alias(f"{c}_x") for c in left.columns)).hint("shuffle_replicate_nl")
    pairs = many.crossJoin(right.select(*(F.col(c).alias(f"{c}_y") for c in right.columns)))
    pairs = pairs.where(where) if where is not None else pairs
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "1")
    try:
        return cut(pairs.mapInArrow(run, schema))
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def vectors(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a pair's side, and their squared lengths, 1 or 0."""
    v = np.frombuffer(batch.column(f"v_{side}")[0].as_py()).reshape(len(batch.column(f"ids_{side}")[0].values), -1)
    return v, np.rint((v * v).sum(1))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[0].as_py())


def rough(v: np.ndarray, extra: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Vectors in single precision with further entries, for products that only say which pairs are worth an exact one."""
    return np.concatenate([v, extra[:, None], *(m[:, None] for m in more)], axis=1).astype(np.float32)


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])
