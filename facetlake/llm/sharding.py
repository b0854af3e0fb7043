"""Sharding by balanced label propagation.

Documents of one group (equal texts) are linked. Every document starts in a
shard by its place in a hashed order, so that counts are at most one apart. Each
round is a few joins: a group's shards are counted, its documents that sit
elsewhere ask to move to the group's fullest shard, and a quota for each pair of
shards says how many may. Quotas only ever swap, in rings of two or more shards: for
each document that enters a shard another one leaves it, a linked one that wants to
or a loose one without links. Counts therefore stay as even as they began. Every move
raises a group's largest share of one shard, so rounds end by themselves: when
no document may move any more.

Groups larger than a shard are cut into whole shards and a rest; all others can
stay whole. Parts of more than half a shard are fewer than twice the shards: each
of the largest gets a shard of its own as its home and moves there alone, since two
of them could only block one another. Other groups keep out of homes as long as
their rows fit elsewhere. Rows move in units of at most ``PART`` of a group and
shard, so no task ranks more of one group. The driver sees shard-by-shard counts
and the large parts alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Rows that are ranked together, about; tables of counts up to this size are sent to every task.
PART, SENT_ROWS = 20_000, 500_000
SALTS = 16


def numbered(rows: DataFrame, by: str, name: str, buckets: int, salt: str, values: int) -> DataFrame:
    """Adds gapless numbers from 0 within each value of ``by``, in a hashed order of ``_id``.

    Rows are ranked within buckets of the hash and shifted by the counts of the
    buckets before; the table of counts has one row for each of ``values`` values and each bucket.
    """
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col("_id"), F.lit(salt)), F.lit(buckets)))
    counts = keyed.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(by, "_bucket").orderBy(F.xxhash64(F.col("_id"), F.lit(salt), F.lit(1)), "_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(inner) - 1)
    # One row for each value and bucket: about the rows of the table by ``PART``.
    return (
        ranked.join(F.broadcast(starts) if buckets * values <= SENT_ROWS else starts.hint("merge"), [by, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_start")
    )


def quotas(wants: dict[tuple[int, int], int], loose: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Linked moves and loose moves (from, to) that leave every shard's count as it is.

    Wishes go round in rings, the shortest first (two shards that swap); what is left forms chains that a loose row of
    the last shard closes. Every ring uses up a wish or a shard's loose rows, so there are at most as many as pairs.
    """
    left, free, linked, filling = dict(wants), dict(loose), {}, {}
    after: dict[int, list[int]] = {}
    for a, b in sorted(wants):
        after.setdefault(a, []).append(b)

    def chain(start: int, ends: Callable[[int], bool]) -> list[int] | None:
        came, queue = {start: None}, [start]
        for k in queue:
            if ends(k):
                found = [k]
                while came[found[-1]] is not None:
                    found.append(came[found[-1]])
                return found[::-1]
            for n in after.get(k, []):
                if left[k, n] > 0 and n not in came:
                    came[n] = k
                    queue.append(n)
        return None

    for closed in (True, False):
        for (i, j), _ in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
            while left[i, j] > 0 and (path := chain(j, (lambda k: k == i) if closed else (lambda k: free.get(k, 0) > 0))):
                steps = [(i, j), *zip(path, path[1:], strict=False)]
                n = min(left[e] for e in steps)
                if not closed:
                    n = min(n, free[path[-1]])
                    free[path[-1]] -= n
                    if path[-1] != i:
                        filling[path[-1], i] = filling.get((path[-1], i), 0) + n
                for e in steps:
                    left[e] -= n
                    linked[e] = linked.get(e, 0) + n
    return linked, filling


def _numbers(values: list[int]) -> Column:
    """A constant array; made from text, which takes one call instead of one for each number."""
    return F.expr(f"array({', '.join(f'{int(v)}L' for v in values)})")


def _pairs(values: dict[tuple[int, int], int], i: Column, j: Column, shards: int) -> Column:
    """Looks a number up by a pair of shards; at most ``shards ** 2`` numbers."""
    flat = [0] * (shards * shards)
    for (a, b), n in values.items():
        flat[a * shards + b] = n
    return F.get(_numbers(flat), i * shards + j)


def cut_links(nodes: DataFrame, by: str = "grp") -> int:
    """Rows that do not share the shard which most of their group's rows have: links that are cut.

    ``by`` names the groups: a column that large groups share counts over the whole of them.
    """
    units = nodes.where(F.col(by).isNotNull()).groupBy(by, "shard").agg(F.count("*").alias("n"))
    groups = units.groupBy(by).agg((F.sum("n") - F.max("n")).alias("cut"))
    return groups.agg(F.sum("cut")).first()[0] or 0


def homes_of(parts: list[tuple[int, int]], shards: int, size: int, linked: int) -> tuple[dict[int, int], list[int]]:
    """A home for each of the largest ``parts`` (group, rows), and the shards that other groups may want.

    ``size`` is what a shard holds. The largest homes are closed to others as long as the rest of the ``linked`` rows fit into open shards.
    """
    order = sorted(parts, key=lambda p: (-p[1], p[0]))[:shards]
    others = linked - sum(n for _, n in order)
    closed = max(0, min(len(order), shards - 1, shards - -(-others // size)))
    return {grp: shard for shard, (grp, _) in enumerate(order)}, list(range(closed, shards))


def propagate(
    nodes: DataFrame, shards: int, buckets: int, rounds: int | None = None, homes: dict[int, int] | None = None, wanted: list[int] | None = None
) -> DataFrame:
    """Moves linked rows of (_id, shard, grp, part, ...) between shards; counts by shard stay.

    ``grp`` is null for rows without links, ``part`` divides large groups. Groups with one of ``homes`` (one for each shard at
    most) move there, others to the fullest of their shards among ``wanted`` (all, if none are named). Ends when no row may
    move; ``rounds`` ends it earlier.
    """
    homes, wanted = homes or {}, wanted or list(range(shards))
    home = F.get(_numbers(list(homes.values())), F.array_position(_numbers(list(homes)), F.col("grp")).cast("int") - 1) if homes else F.lit(None).cast("long")
    fallback = F.get(_numbers(wanted), F.pmod(F.xxhash64("grp", F.lit("open")), F.lit(len(wanted))).cast("int"))
    number = 0
    while rounds is None or number < rounds:
        linked, loose = nodes.where(F.col("grp").isNotNull()), nodes.where(F.col("grp").isNull())
        units = stored(linked.groupBy("grp", "shard", "part").agg(F.count("*").alias("n")), "units")
        held = units.groupBy("grp", "shard").agg(F.sum("n").alias("all"))
        fullest = F.struct("all", F.xxhash64("grp", "shard").alias("tie"), "shard")
        best = held.groupBy("grp").agg(F.max(F.when(F.col("shard").isin(wanted), fullest)).alias("best")).withColumn("home", home)
        # Groups with a home go first; the others in order of what they gain.
        gain = F.when(F.col("home").isNotNull(), F.lit(2**62)).otherwise(F.coalesce("best.all", F.lit(0)) - F.col("all"))
        to = F.coalesce("home", "best.shard", fallback).cast("int")
        wishes = held.join(best, "grp").select("grp", "shard", to.alias("to"), gain.alias("gain"))
        units = stored(units.join(wishes.where("shard <> to"), ["grp", "shard"]), "wishes")
        wants = {(r["shard"], r["to"]): r["n"] for r in units.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        if not wants:
            break
        free = {r["shard"]: r["n"] for r in loose.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        moves, filling = quotas(wants, free)
        if not moves:
            break
        # Units in order of gain take their pair's quota; the last one may move in part.
        order = Window.partitionBy("shard", "to").orderBy(F.desc("gain"), "grp", "part").rowsBetween(Window.unboundedPreceding, -1)
        quota = _pairs(moves, F.col("shard"), F.col("to"), shards)
        chosen = (
            units.withColumn("take", F.least(F.col("n"), quota - F.coalesce(F.sum("n").over(order), F.lit(0))))
            .where("take > 0")
            .select("grp", "shard", "part", "to", "take")
        )
        inner = Window.partitionBy("grp", "shard", "part").orderBy(F.xxhash64(F.col("_id")), "_id")
        moved = (
            linked.join(chosen.hint("merge"), ["grp", "shard", "part"], "left")
            .withColumn("_rank", F.row_number().over(inner))
            .withColumn("shard", F.when(F.col("_rank") <= F.col("take"), F.col("to")).otherwise(F.col("shard")))
            .drop("to", "take", "_rank")
        )
        # Loose rows of a shard: the first ones by number fill other shards, run by run.
        ends = []
        for i in range(shards):
            total = 0
            for j in range(shards):
                total += filling.get((i, j), 0)
                ends.append(total)
        if filling:
            own = F.slice(_numbers(ends), F.col("shard") * shards + 1, F.lit(shards))
            target = F.size(F.filter(own, lambda e: e <= F.col("_place")))
            loose = (
                numbered(loose, "shard", "_place", buckets, f"fill{number}", shards)
                .withColumn("shard", F.when(target < shards, target).otherwise(F.col("shard")).cast("int"))
                .drop("_place")
            )
        nodes = stored(moved.select(*nodes.columns).unionByName(loose.select(*nodes.columns)), "shards")
        number += 1
    return nodes


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, part: int = PART) -> DataFrame:
    """A shard and a slot for every row of ``docs``; counts of shards are at most one apart.

    Returns (id_col, size, text_crc32, law, shard, slot, grown_shard). ``size`` is
    the text's UTF-8 bytes plus 16, the check sum is of the same bytes; a null text
    has none of either and is equal to an empty one. ``law`` is ``rows``,
    ``grown_shard`` null. Rows that repeat an id are rows of their own. Fewer rows
    than shards leave shards empty. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    total = rows.count()
    buckets, size, keys = max(1, total // (shards * part)), max(1, -(-total // shards)), ["key", "size", "text_crc32"]
    placed = stored(numbered(rows.withColumn("_all", F.lit(0)), "_all", "_place", max(1, total // part), "start", 1), "placed")
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1"), "groups")
    # Fewer groups than shards are larger than a shard; their rows are numbered, and every ``size`` of them are a part.
    large = F.broadcast(groups.where(F.col("copies") > size).select(*keys, F.xxhash64(*keys).alias("_group")))
    pieces = numbered(placed.join(large, keys), "_group", "_n", max(1, total // part), "cut", shards).withColumn("piece", F.expr(f"_n div {size}"))
    placed = placed.join(large, keys, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(pieces.drop("_group", "_n"))
    name = F.xxhash64(*keys, "piece")
    cut = groups.where(F.col("copies") * 2 > size).withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {size})")))
    cut = cut.select(name.alias("grp"), F.least(F.lit(size), F.col("copies") - F.col("piece") * size).alias("n")).where(F.col("n") * 2 > size)
    linked = groups.agg(F.sum("copies")).first()[0] or 0
    # Parts of more than half a shard: fewer than two for each shard.
    homes, wanted = homes_of([(r["grp"], r["n"]) for r in cut.collect()], shards, size, linked)
    # A text that a third of all rows hold meets its count in as many tasks as there are salts.
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit("salt")), F.lit(SALTS)).cast("int")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grp = F.when(F.col("copies").isNotNull(), name)
    unit = F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64(F.col("_id"), F.lit("unit")), F.ceil(F.col("copies") / part)).cast("int"))
    nodes = (
        placed.withColumn("salt", salt("_id"))
        .join(salted.hint("merge"), [*keys, "salt"], "left")
        .select("_id", "size", "text_crc32", (F.col("_place") % shards).cast("int").alias("shard"), grp.alias("grp"), unit.alias("part"))
    )
    final = propagate(stored(nodes, "nodes"), shards, buckets, rounds, homes, wanted)
    return numbered(final, "shard", "slot", buckets, "slot", shards).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
