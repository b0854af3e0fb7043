"""Audit of filters in every order: what each removes first, removes in vain, and removes alone.

A task measures whole texts once and keeps four bits of a text, its digest and its id. Equal texts
meet by digest after they were counted by part and label, so a text that fills a third of the table
is a few rows. A row of counts then stands for all documents with the same five bits, part and
labels; a table of 32 patterns by 120 orders says at which step each order removes them, and
``np.bincount`` adds them up by part, order and step. Partial arrays are summed by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

LETTERS = "ABCDE"
ORDERS = list(permutations(range(len(LETTERS))))
NAMES = ["".join(LETTERS[f] for f in order) for order in ORDERS]
STEPS = len(LETTERS)
DUPLICATE = 1 << LETTERS.index("E")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that continue a code point.
INNER = bytes(range(0x80, 0xC0))
MARKS = b"#$%&*|"
#: Rows that are looked up at once, and parts whose arrays a task holds.
ROWS, PARTS = 2048, 256


def first_failures() -> np.ndarray:
    """(32, 120): the step, from 0, at which an order first meets a failing filter of a pattern of bits; 5 where none fails."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for pattern in range(1 << STEPS):
        for k, order in enumerate(ORDERS):
            table[pattern, k] = next((step for step, f in enumerate(order) if pattern >> f & 1), STEPS)
    return table


def failures(text: bytes) -> int:
    """The bits of A to D that a text fails; words are runs of bytes other than space and \\t to \\r."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * len(text.translate(None, INNER))) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, digests = [], []
        for text in batch.column(2):
            raw = text.as_py() or b""
            bits.append(failures(raw))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "bits", "digest"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial arrays of the rows (part, bits, good, toxic, n): one row for each part, order and step."""
    table, orders, filters = first_failures(), np.arange(len(ORDERS)), np.arange(STEPS)
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            piece = batch.slice(at, ROWS)
            names = piece.column(0).dictionary_encode()
            part, bits = names.indices.to_numpy(), piece.column(1).to_numpy()
            n, good, toxic = (piece.column(c).to_numpy() for c in (4, 2, 3))
            parts = len(names.dictionary)
            place = ((part[:, None] * len(ORDERS) + orders) * (STEPS + 1) + table[bits]).ravel()
            each = lambda w: np.bincount(place, np.repeat(w, len(ORDERS)), parts * len(ORDERS) * (STEPS + 1)).reshape(parts, len(ORDERS), STEPS + 1)  # noqa: E731, B023
            removed = each(n)
            by_filter = lambda hit: np.bincount((part[:, None] * STEPS + filters).ravel(), (hit * n[:, None]).ravel(), parts * STEPS).reshape(parts, STEPS)[:, np.array(ORDERS)]  # noqa: E731, B023
            fails = by_filter(bits[:, None] >> filters & 1)
            alone = by_filter(bits[:, None] == 1 << filters)
            kept = removed.sum(2, keepdims=True) - removed[:, :, :STEPS].cumsum(2)
            sums = np.stack([kept, removed[:, :, :STEPS], fails, alone, each(n * good)[:, :, :STEPS], each(n * toxic)[:, :, :STEPS]])
            for p, name in enumerate(names.dictionary.to_pylist()):
                held[name] = held[name] + sums[:, p] if name in held else sums[:, p]
            if len(held) > PARTS:
                yield _rows(held)
                held = {}
    if held:
        yield _rows(held)


def _rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    each = len(ORDERS) * STEPS
    sums = np.rint(np.stack(list(held.values()), 1).reshape(6, -1)).astype(np.int64)
    part = pa.array(np.repeat(np.array(list(held), object), each), pa.string())
    order = np.tile(np.repeat(np.arange(len(ORDERS), dtype=np.int32), STEPS), len(held))
    step = np.tile(np.arange(STEPS, dtype=np.int32), len(held) * len(ORDERS))
    return pa.RecordBatch.from_arrays([part, pa.array(order), pa.array(step), *map(pa.array, sums)], names=["part", "k", "step", "kept", "removed", "fails", "unique_fails", "good_lost", "toxic_lost"])


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, bits, good, toxic, n): how many documents of a part fail exactly these filters and bear these labels."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    measured = stored(read.mapInArrow(_measured, f"id {kind}, part string, bits int, digest binary"), "measured")
    rows = measured.groupBy("id", "part", "bits", "digest").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    known = rows.where(F.col("id").isNotNull()).join(marks, "id", "left").select("id", "part", "bits", "digest", "n", flag("good"), flag("toxic"))
    kinds = ["part", "bits", "good", "toxic"]
    texts = stored(known.groupBy("digest", *kinds).agg(F.min(F.struct("id", "n")).alias("first"), F.sum("n").alias("n")), "audited")
    #: Only texts that several parts or labels share have to meet once more.
    least = texts.groupBy("digest").agg(F.min("first.id").alias("least"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    first = F.when(F.coalesce("least", "first.id") == F.col("first.id"), F.col("first.n")).otherwise(F.lit(0))
    both = texts.join(least, "digest", "left").withColumn("passed", first)
    sides = F.array(F.struct(F.col("bits").alias("b"), F.col("passed").alias("m")), F.struct((F.col("bits") + DUPLICATE).alias("b"), (F.col("n") - F.col("passed")).alias("m")))
    named = both.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", F.col("s.b").alias("bits"), "good", "toxic", F.col("s.m").alias("n"))
    zero = F.lit(0)
    unnamed = rows.where(F.col("id").isNull()).select("part", "bits", zero.alias("good"), zero.alias("toxic"), "n")
    return named.where("n > 0").unionByName(unnamed)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step: the counts of what happens there.

    A: under 50 words. B: fewer than 65 distinct words in 100. C: more than 5 capitals A-Z in 100 code points. D: any of
    ``#$%&*|``. E: the text of a smaller id, anywhere in the table. Columns: part, filter_order, step (from 1), kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (what the filter removes, over all orders).

    A null text is empty, a null part the empty string. Rows that repeat an id count each, and none is the other's copy.
    A null id has no label, is smaller than none and follows none, so E never removes its row. A label that repeats counts
    if any of its rows says so; null labels say nothing. Empty tables give no rows; further columns are ignored.
    """
    found = patterns(docs, labels, id_col, text_col, part_col).select("part", "bits", "good", "toxic", "n")
    longs = ["kept", "removed", "fails", "unique_fails", "good_lost", "toxic_lost"]
    partial = found.mapInArrow(_counts, "part string, k int, step int, " + ", ".join(f"{c} long" for c in longs))
    summed = partial.groupBy("part", "k", "step").agg(*(F.sum(c).alias(c) for c in longs))
    order = F.element_at(F.array(*map(F.lit, NAMES)), F.col("k") + 1)
    rows = summed.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step") + 1, F.lit(1)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return rows.select(
        "part", "filter_order", (F.col("step") + 1).alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"),
    )
