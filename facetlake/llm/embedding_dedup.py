"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Vectors of equal bytes are one node with a weight. A node is sketched by the signs of ``BITS`` random hyperplanes, and a
table reads some of these bits as its bucket; the number of bits grows with the logarithm of the number of nodes, which
keeps buckets small, and the number of tables follows from the recall that a pair at the threshold has to have.

The first pass shuffles sketches only: two nodes of a bucket are candidates in the first table that they share, if
their sketches differ in no more bits than a linked pair's would (six standard deviations are allowed). The second
pass sends vectors to the buckets where a node has a candidate, and compares cosines. Both passes return a row for each
node, not for each pair: a weight of links, and the node that it hangs from in a forest of the links.

Crowded buckets are split into blocks, and two blocks are one group of bounded size. Where many vectors lie within half
the threshold's angle of the mean of a crowd, they are a kernel: all of them link by the triangle inequality of angles,
they are counted as one and never compared with one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acos, ceil, comb, cos, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import stored

#: Hyperplanes of a sketch, and nodes that the average bucket holds at most.
BITS, SHARE = 256, 64
#: Share of the pairs at the threshold itself that some table has to find.
RECALL = 0.999
#: Rows of a block, rows that are compared at once, and rows of a bucket that is looked at for kernels.
BLOCK, ROWS, CROWD = 512, 4096, 2048
#: Crowds that are looked at in one round, and room for rounding at a kernel's border.
CROWDS, SLACK = 64, 1e-9
SEED = 11


@dataclass(frozen=True)
class Tables:
    """``places``: the bits of a sketch that each table reads; ``differ``: the most bits in which a candidate's sketches differ."""

    places: np.ndarray
    differ: int

    @property
    def masks(self) -> np.ndarray:
        """(tables, BITS / 64): the bits of each table within a sketch."""
        bits = np.zeros((len(self.places), BITS), np.uint8)
        np.put_along_axis(bits, self.places, 1, 1)
        return np.packbits(bits, axis=1).view(np.uint64)


def tables(nodes: int, threshold: float, recall: float = RECALL) -> Tables:
    """As many bits as buckets of about ``SHARE`` nodes need, and as many tables as ``recall`` needs at the threshold."""
    apart = acos(threshold) / pi
    k = min(32, max(8, ceil(log2(max(nodes, 1) / SHARE))))
    chance = [comb(BITS, h) * apart**h * (1 - apart) ** (BITS - h) for h in range(BITS + 1)]
    found = [comb(BITS - h, k) / comb(BITS, k) for h in range(BITS + 1)]
    n = 1
    while sum(p * (1 - f) ** n for p, f in zip(chance, found, strict=True)) > 1 - recall and n < 500:
        n += 1
    rng = np.random.default_rng(SEED)
    places = np.stack([rng.choice(BITS, k, False) for _ in range(n)])
    return Tables(places, ceil(BITS * apart + 6 * sqrt(BITS * apart * (1 - apart))))


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as doubles, each divided by a power of two (which is exact) to keep squares finite."""
    v = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def sketches(v: np.ndarray) -> np.ndarray:
    """(rows, BITS / 8) bytes: the signs of inner products with fixed random directions."""
    planes = np.random.default_rng([SEED, v.shape[1]]).standard_normal((v.shape[1], BITS))
    return np.packbits(v @ planes >= 0, axis=1)


def _by_length(vectors: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, vec): a vector's bytes and their digest; both null where it can link with nothing."""
    for batch in batches:
        column = batch.column(1)
        kind = np.dtype("<f4") if column.type.value_type == pa.float32() else np.dtype("<f8")
        out: list[bytes | None] = []
        for row in column:
            v = np.array(row.as_py(), np.float64) if row.is_valid else np.zeros(0)
            out.append(v.astype(kind).tobytes() if np.isfinite(v).all() and v.any() else None)
        digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(out, pa.binary())], names=["id", "digest", "vec"])


def _nodes(rows: DataFrame, kind: str) -> DataFrame:
    """(node, digest, id, n, dims, vec, sketch, kernel) of each distinct vector; ``n`` rows have it, ``id`` is the smallest."""
    id_kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            out = np.zeros((len(vectors), BITS // 8), np.uint8)
            for at in _by_length(vectors):
                out[at] = sketches(units([vectors[i] for i in at], kind))
            dims = pa.array([len(v) // width for v in vectors], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], dims, batch.column(3), pa.array([r.tobytes() for r in out], pa.binary())], names=["digest", "id", "n", "dims", "vec", "sketch"])

    once = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    shape = f"digest binary, id {id_kind}, n long, dims int, vec binary, sketch binary"
    sketched = once.select("digest", "id", "n", "vec").mapInArrow(sketch, shape)
    return stored(sketched.select(F.monotonically_increasing_id().alias("node"), "*", F.lit(-1).alias("kernel")), "nodes")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _keys(sketch: np.ndarray, dims: np.ndarray, places: np.ndarray, first: int = 0) -> np.ndarray:
    """(rows, tables): buckets as numbers of the vectors' length, the table and its bits."""
    bits = np.unpackbits(sketch, axis=1)
    weights = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    codes = np.stack([bits[:, p].astype(np.int64) @ weights for p in places], 1) if len(sketch) else np.zeros((0, len(places)), np.int64)
    return (dims.astype(np.int64)[:, None] << 41) | (np.arange(first, first + len(places), dtype=np.int64) << 32) | codes


def _table_of(key: np.ndarray) -> np.ndarray:
    return (key >> 32) & 511


def _placed(nodes: DataFrame, plan: Tables) -> DataFrame:
    """(key, node, kernel, sketch): each node in its bucket of every table."""
    sent = nodes.sparkSession.sparkContext.broadcast(plan.places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                piece = batch.slice(at, ROWS)
                keys = _keys(_bits(piece.column(2)), piece.column(3).to_numpy(), places)
                each = pa.array(np.repeat(np.arange(len(piece)), len(places)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(piece.column(c).take(each) for c in (0, 1, 2))], names=["key", "node", "kernel", "sketch"])

    return nodes.select("node", "kernel", "sketch", "dims").mapInArrow(run, "key long, node long, kernel int, sketch binary")


def _grouped(placed: DataFrame, block: int) -> DataFrame:
    """Adds (lo, hi, side): the two blocks that a group compares. Buckets of at most ``block`` rows are one block.

    Blocks of larger buckets hold one kernel or no kernel's nodes, and two blocks of one kernel do not meet.
    """
    sizes = placed.groupBy("key", "kernel").agg(F.count("*").alias("rows"))
    whole = sizes.groupBy("key").agg(F.sum("rows").alias("all")).where(F.col("all") > block).select("key")
    parts = sizes.join(whole, "key").withColumn("parts", F.ceil(F.col("rows") / block).cast("int"))
    before = Window.partitionBy("key").orderBy("kernel").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("key", "kernel", "parts", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int").alias("start")), "crowded")
    plain = placed.select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"))
    if parts.isEmpty():
        return plain
    others = parts.groupBy("key").agg(F.collect_list(F.struct("kernel", "start", "parts")).alias("others"))
    crowded = parts.join(others, "key")
    own = placed.join(crowded, ["key", "kernel"], "left")
    side = (F.col("start") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    meets = F.filter("others", lambda o: (F.col("kernel") < 0) | (o.kernel != F.col("kernel")))
    blocks = F.flatten(F.transform(meets, lambda o: F.sequence(o.start, o.start + o.parts - 1)))
    split = own.where(F.col("start").isNotNull()).withColumn("side", side).withColumn("other", F.explode(blocks))
    split = split.select("key", "node", "kernel", "sketch", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side")
    return own.where(F.col("start").isNull()).select(*plain.columns[:4], F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")).unionByName(split)


GROUP = ["key", "lo", "hi"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, of at least ``ROWS`` rows but for the last; the rows of a group follow one another."""
    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < 2 * ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        names = np.stack([table.column(c).to_numpy() for c in GROUP])
        starts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
        at = 0
        while rows - at >= ROWS and (after := starts[starts >= at + ROWS]).size:
            yield table.slice(at, int(after[0]) - at).combine_chunks()
            at = int(after[0])
        held, rows = table.slice(at).to_batches(), rows - at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(table: pa.Table, plan: Tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of candidate pairs in a table of whole groups: every pair once, in the first table that it shares."""
    names = np.stack([table.column(c).to_numpy() for c in GROUP])
    start = np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(0)])
    number = np.cumsum(start) - 1
    ends = np.concatenate([np.flatnonzero(start)[1:], [len(table)]])[number]
    words = _bits(table.column("sketch").combine_chunks()).view(np.uint64)
    kernel, side = table.column("kernel").to_numpy(), table.column("side").to_numpy()
    across, of, masks = names[1] != names[2], _table_of(names[0]), plan.masks
    left = np.arange(len(table))
    d = 0
    while True:
        d += 1
        left = left[left + d < ends[left]]
        if not len(left):
            return
        a, b = left, left + d
        ok = ((kernel[a] < 0) | (kernel[a] != kernel[b])) & (~across[a] | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        gap = words[a] ^ words[b]
        near = np.bitwise_count(gap).sum(1) <= plan.differ
        a, b, gap = a[near], b[near], gap[near]
        first = np.ones(len(a), bool)
        for t in range(int(of[a].max(initial=0))):
            first &= (of[a] <= t) | (gap & masks[t]).any(1)
        if first.any():
            yield a[first], b[first]


def _flags(plan: Tables) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows (key, lo, hi, side, node) that have a candidate in their group."""
        for table in _runs(batches):
            some = np.zeros(len(table), bool)
            for a, b in _candidates(table, plan):
                some[a] = some[b] = True
            yield from table.select([*GROUP, "side", "node"]).filter(pa.array(some)).to_batches()

    return run


def _heads(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The first row that each row reaches by the links (a, b)."""
    head = np.arange(rows)
    while True:
        low = np.minimum(head[a], head[b])
        new = head.copy()
        np.minimum.at(new, head[a], low)
        np.minimum.at(new, head[b], low)
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _links(plan: Tables, kind: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, links, head): the weight of the nodes linked with it in this piece, and the node that leads them."""
        for table in _runs(batches):
            vectors = table.column("vec").to_pylist()
            unit: list[np.ndarray | None] = [None] * len(vectors)
            for at in _by_length(vectors):
                v = units([vectors[i] for i in at], kind)
                for i, row in zip(at, v, strict=True):
                    unit[i] = row
            length = np.array([sqrt(float(v @ v)) for v in unit])
            n, node = table.column("n").to_numpy(), table.column("node").to_numpy()
            weight, ends = np.zeros(len(table), np.int64), []
            for a, b in _candidates(table, plan):
                for p in range(0, len(a), ROWS):
                    i, j = a[p : p + ROWS], b[p : p + ROWS]
                    dot = np.array([float(unit[x] @ unit[y]) for x, y in zip(i, j, strict=True)]) if len({len(unit[x]) for x in i}) > 1 else np.einsum("ij,ij->i", np.stack([unit[x] for x in i]), np.stack([unit[y] for y in j]))
                    ok = dot / (length[i] * length[j]) >= threshold
                    i, j = i[ok], j[ok]
                    np.add.at(weight, i, n[j])
                    np.add.at(weight, j, n[i])
                    ends.append((i, j))
            if not ends:
                continue
            head = _heads(np.concatenate([i for i, _ in ends]), np.concatenate([j for _, j in ends]), len(table))
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(weight[some]), pa.array(node[head[some]])], names=["node", "links", "head"])

    return run


def _kernels(nodes: DataFrame, plan: Tables, kind: str, threshold: float, crowd: int) -> DataFrame:
    """Numbers the kernels of crowds: nodes within half the threshold's angle of the mean of a bucket of over ``crowd`` nodes.

    Each round looks at the largest buckets of the first table, at most ``CROWDS``, and ends when it gains fewer nodes
    than a crowd has. What no kernel takes is compared by blocks, so results do not depend on it.
    """
    spark, first, half = nodes.sparkSession, plan.places[:1], cos(acos(threshold) / 2) + SLACK
    made = 0
    while True:
        free = nodes.where("kernel < 0")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_keys(_bits(batch.column(0)), batch.column(1).to_numpy(), first)[:, 0])], names=["key"])

        counts = free.select("sketch", "dims").mapInArrow(keyed, "key long").groupBy("key").agg(F.count("*").alias("n"))
        top = [r.key for r in counts.where(F.col("n") > crowd).orderBy(F.desc("n"), "key").limit(CROWDS).collect()]
        if not top:
            return nodes

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                keys, vectors = _keys(_bits(batch.column(0)), batch.column(1).to_numpy(), first)[:, 0], batch.column(2).to_pylist()
                for key in set(keys.tolist()).intersection(top):  # noqa: B023
                    v = units([vectors[i] for i in np.flatnonzero(keys == key)], kind)
                    total = (v / np.linalg.norm(v, axis=1, keepdims=True)).sum(0)
                    held[key] = held[key] + total if key in held else total
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["key", "v"])

        each = free.select("sketch", "dims", "vec").mapInArrow(sums, "key long, v array<double>").select("key", F.posexplode("v").alias("d", "x"))
        total: dict[int, dict[int, float]] = {}
        for r in each.groupBy("key", "d").agg(F.sum("x").alias("x")).collect():
            total.setdefault(r.key, {})[r.d] = r.x
        pivots: list[np.ndarray] = []
        for key in top:
            p = np.array([total[key][d] for d in range(len(total[key]))])
            p = p / max(float(np.linalg.norm(p)), 1e-300)
            if all(len(q) != len(p) or float(q @ p) < threshold for q in pivots):
                pivots.append(p)
        sent = spark.sparkContext.broadcast((pivots, made))

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, base = sent.value
            for batch in batches:
                kernel, vectors = batch.column(7).to_numpy().copy(), batch.column(5).to_pylist()
                for at in _by_length(vectors):
                    v = units([vectors[i] for i in at], kind)
                    fit = [k for k, p in enumerate(pivots) if len(p) == v.shape[1]]
                    if fit:
                        c = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ np.stack([pivots[k] for k in fit]).T
                        best = c.argmax(1)
                        own = (c[np.arange(len(v)), best] >= half) & (kernel[at] < 0)
                        kernel[at[own]] = base + np.array(fit)[best[own]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(kernel)], names=batch.schema.names)

        nodes = stored(nodes.mapInArrow(take, nodes.schema), "nodes")
        gained = nodes.where(F.col("kernel") >= made).count()
        made += len(pivots)
        if gained < crowd:
            return nodes


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
    recall: float = RECALL, block: int = BLOCK, crowd: int = CROWD,
) -> DataFrame:
    """One row for each vector: (id, n_links, component_id, kept), by cosine of at least ``threshold`` in double precision.

    Links are exact: none lies below the threshold. A pair at the threshold is found with a chance of ``recall``, closer
    ones with more (0.9999 at 0.95). Vectors that are null, empty, zero or hold a null or non-finite entry link with
    nothing and keep their own id; so do vectors of different lengths. Repeated rows and equal vectors link with each
    other. ``component_id`` is the smallest id reached, null ids aside; ``kept`` says that an id is its component's, and
    holds for a null id that reaches no other. An empty table gives no rows; further columns are ignored.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    entries = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    read = vectors.select(F.col(id_col).alias("id"), entries.alias("v"))
    id_kind = read.schema["id"].dataType.simpleString()
    rows = read.mapInArrow(_named, f"id {id_kind}, digest binary, vec binary")
    nodes = _nodes(rows, kind)
    plan = tables(nodes.count(), threshold, recall)
    nodes = _kernels(nodes, plan, kind, threshold, crowd)
    grouped = _grouped(_placed(nodes, plan), block)
    flags = grouped.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_flags(plan), "key long, lo int, hi int, side int, node long")
    flags = stored(flags, "candidates")
    sent = flags.join(nodes.select("node", "kernel", "sketch", "n", "vec"), "node")
    found = sent.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_links(plan, kind, threshold), "node long, links long, head long")
    found = stored(found, "links")
    kernels = nodes.where("kernel >= 0").groupBy("kernel").agg(F.min("node").alias("head"), F.sum("n").alias("all"))
    members = nodes.where("kernel >= 0").join(F.broadcast(kernels), "kernel").select("node", (F.col("all") - F.col("n")).alias("links"), "head")
    every = found.unionByName(members)
    labels = components(every.select(F.col("node").alias("a"), F.col("head").alias("b")))
    weights = every.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "digest", "id", "n").join(weights, "node", "left").join(labels, "node", "left")
    known = stored(known.select("digest", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("label", "node").alias("label")), "weighed")
    least = known.groupBy("label").agg(F.min("id").alias("component_id"))
    some = known.where("links > 0").join(least, "label").select("digest", "links", "component_id")
    named = rows.select("id", "digest")
    with_links = named.where(F.col("digest").isNotNull()).join(some, "digest", "left")
    done = with_links.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    alone = named.where(F.col("digest").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = done.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
