"""A bounded bitmap of hashes that tells most rows apart before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map; its words are at most ``2 ** (BITS - 6)`` rows of two numbers.
BITS = 26


def bitmap(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(word, bits) of the leading bits of the 64-bit hashes in ``key``; at most ``2 ** (bits - 6)`` rows."""
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    return (
        keys.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    )


def flagged(rows: DataFrame, key: Column, keys: DataFrame, among: str, name: str, bits: int = BITS) -> DataFrame:
    """Adds a boolean ``name``: true for every row whose ``key`` is in ``keys.among``, and by chance for a few others.

    The bitmap is broadcast: its size is bounded by ``bits``, not by the data. Past some ``2 ** bits``
    keys it lets more rows through, which costs a shuffle of them and changes no result.
    """
    place = F.shiftrightunsigned(key, 64 - bits)
    words = bitmap(keys, among, bits).select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    hit = F.expr("(shiftrightunsigned(_bits, cast(_place & 63 as int)) & 1) = 1")
    return (
        rows.withColumn("_place", place)
        .withColumn("_word", F.shiftright("_place", 6))
        .join(F.broadcast(words), "_word", "left")
        .withColumn(name, F.coalesce(hit, F.lit(False)))
        .drop("_word", "_place", "_bits")
    )
