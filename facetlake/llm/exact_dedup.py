"""Exact deduplication over an extendible-hash index kept in shared files.

DataFrame functions only. The steps:

1. every row gets the 64-bit hash and SHA-256 of its normalised text;
2. the directory starts with ``2**start_depth`` buckets of leading hash bits.
   While a bucket holds more than ``capacity`` distinct hashes the directory
   doubles, and the overfull buckets alone are split by one more bit;
3. hashes and their counts are written to shared index files, sorted by bucket,
   so that a range of buckets (keys) belongs to one owner task. Hashes that
   several rows share are chains;
4. the texts of chains are fetched, combined by bucket, hash and bytes where
   they are read, and dealt to the bucket's owner, who compares the bytes of
   each chain: equal hashes of different texts stay apart.

A bitmap of the chained hashes, bounded in size, is sent to the scan: texts
whose hash no other row has never leave it. A text that a third of all rows
hold arrives at its owner a few times from each of ``salts`` combining tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import flagged
from .storage import stored

#: Java's regular expression for runs of blanks that count as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of blanks becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _leading(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a signed 64-bit key as a non-negative number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int = 4096, start_depth: int = 4, max_depth: int = 24, step: int = 12) -> tuple[DataFrame, int]:
    """The directory of an extendible hash index over distinct ``key`` values.

    Returns (slot, bucket, depth) with one row for each of ``2**depth`` slots, and
    the global depth. A bucket is named by the first of its keys' leading
    ``max_depth`` bits, so buckets lie in the order of their keys. Keys are counted once for ``step``
    doublings. A bucket that is still overfull at ``max_depth`` stays whole. An
    empty table gives the starting directory.
    """
    depth = fine = start_depth
    counts = None
    leaves = keys.sparkSession.range(2**depth).select(F.col("id").alias("prefix"), F.lit(depth).alias("depth"))
    while depth < max_depth:
        if counts is None or depth >= fine:
            fine = min(max_depth, depth + step)
            counts = stored(keys.groupBy(_leading(F.col("key"), fine).alias("slot")).agg(F.count("*").alias("n")), "counts")
        held = counts.groupBy(F.shiftrightunsigned("slot", fine - depth).alias("prefix")).agg(F.sum("n").alias("n"))
        full = stored(held.where(F.col("n") > capacity).select("prefix"), "overfull")
        if full.isEmpty():
            break
        split = full.select(F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        at_depth = F.col("depth") == depth
        leaves = stored(
            leaves.join(full.withColumn("full", F.lit(True)), "prefix", "left")
            .where(~at_depth | F.col("full").isNull())
            .select("prefix", "depth")
            .unionByName(split.withColumn("depth", F.lit(depth + 1))),
            "directory",
        )
        depth += 1
    span = F.expr(f"shiftleft(1L, {depth} - depth)")
    directory = leaves.select(
        F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1)).alias("slot"),
        F.expr(f"shiftleft(prefix, {max_depth} - depth)").alias("bucket"),
        "depth",
    )
    return directory, depth


#: Slots of a directory that is sent to every task; a larger one is joined by slot.
SENT_SLOTS = 1 << 20


def _in_buckets(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """Adds each row's bucket, looked up by the leading bits of its ``key``."""
    named = directory.select("slot", "bucket")
    sent = F.broadcast(named) if 1 << depth <= SENT_SLOTS else named.hint("merge")
    return rows.withColumn("slot", _leading(F.col("key"), depth)).join(sent, "slot").drop("slot")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, salts: int = 16, key_bits: int = 64
) -> DataFrame:
    """One row for each row of ``docs``: who stays for its group of equal texts.

    Returns (id_col, keep_id, group_size, kept, text_sha256). Texts are
    equal if they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one
    space; null counts as empty, so null and empty texts form one group. The
    smallest id of a group stays. Rows that repeat an id are counted each, and all
    of them are kept if that id stays; a null id stays only in a group without
    another. Other columns of ``docs``, whatever their
    names, are ignored. An empty table gives an empty result. ``key_bits`` is how
    many bits of the hash are used: few make different texts clash.
    """
    hashed = F.xxhash64("_norm")
    if key_bits < 64:
        hashed = F.shiftleft(F.shiftrightunsigned(hashed, 64 - key_bits), 64 - key_bits)
    sha = lambda text: F.sha2(F.col(text).cast("binary"), 256).alias("sha")
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("salt")
    named = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")).withColumn("key", hashed)
    entries = stored(named.select("_id", "key", sha("_norm")), "entries")
    keys = stored(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    directory, depth = build_directory(keys, capacity)
    # The index files hold the buckets in order of their keys: a range of buckets has one owner.
    index = stored(_in_buckets(keys, directory, depth).repartitionByRange("bucket").sortWithinPartitions("bucket", "key"), "index")
    chains = index.where("n > 1").select("key")
    # Texts that may be in a chain are combined where they are read, then owners compare what is left.
    texts = _in_buckets(flagged(named, F.col("key"), chains, "key", "chained").where("chained"), directory, depth)
    combined = texts.groupBy("bucket", "key", salt, "_norm").agg(F.min("_id").alias("least"), F.count("*").alias("n"))
    links = (
        combined.repartitionByRange("bucket")
        .groupBy("bucket", "key", "_norm")
        .agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("key", sha("_norm"), "keep_id", "group_size")
    )
    links = stored(links, "links")
    marked = flagged(entries, F.col("key"), chains, "key", "chained")
    # Copies meet their group's row in ``salts`` parts. Links grow with the table, so they are never broadcast.
    parts = links.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = marked.where("chained").select("_id", "key", "sha", salt).join(parts.hint("merge"), ["key", "sha", "salt"])
    alone = marked.where("not chained").select("_id", "sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return copies.select(*alone.columns).unionByName(alone).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("keep_id").eqNullSafe(F.col("_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
