"""Exact Jaccard join of word-shingle sets in metric space.

Documents with equal sets are one node. Regions come from pivots, level by level:

* The first pivots are sets of one shingle. The Jaccard distance of a node to such a
  pivot is ``1 - 1/n`` if it holds the shingle and 1 otherwise, so a node is nearest to
  the shingles that it holds; rare ones come first among equals and name its
  home. A linked node lacks at most ``n - ceil(t * n)`` of a node's n shingles, so
  replicating the node to its first ``n - ceil(t * n) + 1`` pivots, the boundary
  window, puts every link inside some region. (Unrelated documents are all at distance 1 from
  document pivots, so those would copy nearly every document to every region here.)
* Each node meets one other that lies amid its regions, in its own window of sizes.
  What links joins; a region that now is one component is done. A region that
  still holds more than ``region`` components says that its shingle is frequent: such
  shingles go last in the order and regions are made anew, as long as that helps.
* Regions that are left recurse. A crowded region is divided by pivots that are
  nodes of it, into Voronoi regions of the symmetric difference of two nodes' counts
  over a fixed family of pivot sets. That distance never exceeds the nodes' own
  symmetric difference, which is ``n * (1 - t) / t`` at most for a link, so by the
  triangle inequality a node is replicated to every pivot no farther than its
  nearest one and twice that. Regions recurse while that divides them; one that it
  does not divide is dealt into pairs of blocks.
* In small regions pairs of different components are tested by the same bound.
  Nearest pairs are compared exactly first; the last round takes every pair that is left.

The order of shingles is a matter of work alone: any order gives the same links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .filters import bitmap
from .storage import stored
from .textarrays import WORD_CLASS, chunks, lowered, mixed, powers, tokens, windows

#: Pivot sets of the fixed family: a power of two from half a node's shingles on, within these.
LEAST_CLASSES, MOST_CLASSES = 64, 16_384
#: Pivot sets of the coarse family that goes with the regions' rows.
COARSE = 128
#: A first guess: a shingle is frequent from this share of a batch's rows on, and this many rows.
FREQUENT_SHARE, FREQUENT_ROWS = 0.002, 20
#: Rows of a region that is compared at once, pivots of a crowded one, and rows of a block of one that pivots do not divide.
REGION, PIVOTS, BLOCK = 1024, 8, 4096
#: Rows of a table that is sent to every task after a count; a larger one is joined by its key.
SENT_ROWS = 200_000
#: Bits of the filter that says which rows' sets are wanted; 16 MB at most.
FILTER_BITS = 27


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; A-Z count as a-z.

    A row with fewer than ``width`` words has its whole sequence as one shingle, a
    row without words has none.
    """
    hashes, _, _, bounds = tokens(lowered(data), offsets, WORD_CLASS)
    full = windows(hashes, width)
    step = powers(width + 1)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            whole = (hashes[a:b] * step[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mixed(np.array([whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _fingerprint(own: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """128 bits that tell sets apart, in two halves: the first names the node, the second tells clashes."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketch(own: np.ndarray, classes: int | None = None) -> bytes:
    """How many shingles lie in each pivot set of the family, up to 255."""
    classes = classes or min(MOST_CLASSES, max(LEAST_CLASSES, 1 << (max(len(own) // 2, 1) - 1).bit_length()))
    at = (own >> np.uint64(40)).astype(np.int64) & (classes - 1)
    return np.minimum(np.bincount(at, minlength=classes), 255).astype(np.uint8).tobytes()


def _folded(sketch: bytes, classes: int) -> np.ndarray:
    """The sketch over fewer pivot sets, each the union of some of its own."""
    return np.frombuffer(sketch, np.uint8).reshape(-1, classes).sum(0, dtype=np.int32)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _nodes(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """(_id, n, fp, other, sketch, coarse) of every row, and (shingle, rows) of what is frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "n", "fp", "other", "sketch", "coarse", "shingle", "rows"]
        for batch in batches:
            seen = []
            for row, end, data, offsets in chunks(batch.column(1)):
                n, fp, other, sketch, coarse, kept = [], [], [], [], [], []
                for own in shingle_sets(data, offsets, width):
                    one, two = _fingerprint(own, salt) if len(own) else (None, None)
                    n.append(len(own))
                    fp.append(one)
                    other.append(two)
                    sketch.append(_sketch(own) if len(own) else None)
                    coarse.append(_sketch(own, COARSE) if len(own) else None)
                    kept.append(own)
                seen += kept
                none = pa.nulls(end - row, pa.int64())
                longs = [pa.array(x, pa.int64()) for x in (n, fp, other)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), *longs, pa.array(sketch, pa.binary()), pa.array(coarse, pa.binary()), none, none], names=names
                )
            codes, rows = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = rows >= max(FREQUENT_ROWS, FREQUENT_SHARE * len(batch))
            k = int(often.sum())
            if k:
                none = [pa.nulls(k, batch.schema.field(0).type), *[pa.nulls(k, pa.int64()) for _ in range(3)], pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, _long(codes[often]), _long(rows[often])], names=names)

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, n long, fp long, other long, sketch binary, coarse binary, shingle long, rows long")


def _regions(docs: DataFrame, width: int, num: int, den: int, late: tuple[np.ndarray, int], salt: int) -> DataFrame:
    """(cell, fp, n): every row's first pivots, those in the bitmap ``late`` after all others."""
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = sent.value
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(1)):
                cells, fps, ns = [], [], []
                for own in shingle_sets(data, offsets, width):
                    n = len(own)
                    if not n:
                        continue
                    place = (own >> np.uint64(64 - bits)).astype(np.int64)
                    often = (bitmap[place >> 6] >> (place & 63)) & 1 == 1
                    cells.append(np.concatenate([own[~often], own[often]])[: n - (num * n + den - 1) // den + 1])
                    fps.append(_fingerprint(own, salt)[0])
                    ns.append(n)
                if cells:
                    counts = [len(c) for c in cells]
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.concatenate(cells)), pa.array(np.repeat(np.array(fps, np.int64), counts)), pa.array(np.repeat(np.array(ns, np.int64), counts))],
                        names=["cell", "fp", "n"],
                    )

    return docs.mapInArrow(run, "cell long, fp long, n long")


def _runs(batches: Iterator[pa.RecordBatch], key: int, most: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from rows sorted by them."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        size += len(batch)
        if size >= most:
            table = pa.concat_tables(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
            held, size = [table.slice(cut)], len(table) - cut
            most = max(most, 2 * size)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shared(regions: DataFrame) -> DataFrame:
    """Regions of two or more nodes as (cell, fp, n), each node once.

    Rows come sorted, so a task holds one batch and the row before it, however large a region is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "fp", "n"]
        held, known = None, False  # the last row so far, and whether its region is known to have others
        for batch in batches:
            if not len(batch):
                continue
            cell, n, fp = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                cell, n, fp = (np.concatenate([[x], y]) for x, y in zip(held, (cell, n, fp), strict=True))
            keep = np.ones(len(cell), bool)
            keep[1:] = (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])
            cell, n, fp = cell[keep], n[keep], fp[keep]
            same = cell[1:] == cell[:-1]
            shared = np.concatenate([[known and held is not None], same]) | np.concatenate([same, [False]])
            held, known = (cell[-1], n[-1], fp[-1]), bool(shared[-1])
            yield pa.RecordBatch.from_arrays([_long(x[:-1][shared[:-1]]) for x in (cell, fp, n)], names=names)
        if held is not None and known:
            yield pa.RecordBatch.from_arrays([pa.array([int(held[i])], pa.int64()) for i in (0, 2, 1)], names=names)

    dealt = regions.repartition("cell").sortWithinPartitions("cell", "n", "fp").select("cell", "n", "fp")
    return dealt.mapInArrow(run, "cell long, fp long, n long")


def _stars(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each node and the pivot that most of its regions have.

    A region's pivot for a window of sizes is the node whose regions are fullest, which lies amid
    its copies. All is counted and compared before it is shuffled, so a full region is no task's own.
    """
    # Nodes within one class differ in size by a link's most.
    window = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num + 1e-9))).alias("class") if num < den else F.col("n").alias("class")
    sizes = shared.groupBy("cell").agg(F.count("*").alias("size"))
    sized = shared.select("cell", "fp", "n").join(sizes, "cell")
    full = sized.groupBy("fp").agg((F.sum("size") / (F.first("n") - F.ceil(F.first("n") * num / den) + 1)).alias("full"))
    placed = shared.select("cell", "fp", window).join(full, "fp")
    pivots = placed.groupBy("cell", "class").agg(F.max(F.struct("full", "fp")).alias("m")).select("cell", "class", F.col("m.fp").alias("pivot"))
    votes = placed.join(pivots, ["cell", "class"]).where("fp <> pivot").groupBy("fp", "pivot").agg(F.count("*").alias("k"))
    best = votes.groupBy("fp").agg(F.max(F.struct("k", "pivot")).alias("best")).select("fp", F.col("best.pivot").alias("pivot"))
    return best.select(F.least("fp", "pivot").alias("a"), F.greatest("fp", "pivot").alias("b")).distinct()


def _met(rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined on ``cell`` with a stored table of regions, which is sent to all tasks if a count says that it is small."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_ROWS else keys.hint("merge"), "cell", how)


def _voronoi(rows: DataFrame, pivots: DataFrame, num: int, den: int) -> DataFrame:
    """Every row once in the region of its nearest pivot and once in each that its window reaches.

    ``rows`` are (cell, fp, n, label, coarse); ``pivots`` has an array of sketches for each cell. Returns the
    same columns, ``cell`` naming the new region, and ``parent``. A link's sketches differ by
    ``n * (1 - t) / t`` at most, so both ends are in the region of either's nearest pivot.
    """
    columns = ["cell", "fp", "n", "label", "coarse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                if not len(part):
                    continue
                own = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(len(part), 1, COARSE).astype(np.int16)
                there = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(len(part), PIVOTS, COARSE).astype(np.int16)
                far = np.abs(own - there).sum(2, dtype=np.int64)
                window = 2 * (den - num) * part.column(2).to_numpy() // num + 1
                row, pivot = np.nonzero(far <= (far.min(1) + window)[:, None])
                took = part.select([1, 2, 3, 4, 0]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(pivot, pa.int64())], names=["fp", "n", "label", "coarse", "parent", "pivot"])

    dealt = rows.join(pivots, "cell").select(*columns, "pivots")
    placed = dealt.mapInArrow(run, "fp long, n long, label long, coarse binary, parent long, pivot long")
    return placed.select(F.xxhash64("parent", "pivot").alias("cell"), "fp", "n", "label", "coarse", "parent")


def _divided(rows: DataFrame, num: int, den: int, region: int, block: int) -> DataFrame:
    """Rows (cell, fp, n, label, coarse) with crowded regions divided, so that each pair that may link still shares one.

    A region recurses while its parts hold at most twice its rows and none nearly all of them; one that
    pivots do not divide is dealt into blocks, and a region is made of every two blocks.
    """
    columns = ["cell", "fp", "n", "label", "coarse"]
    done, level = None, rows
    add = lambda more: more.select(*columns) if done is None else done.unionByName(more.select(*columns))
    while True:
        big = stored(level.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > region), "crowded")
        if big.isEmpty():
            return add(level)
        done = add(_met(level, big.select("cell"), "left_anti"))
        crowded = _met(level, big.select("cell"), "left_semi")
        sketch = [F.min(F.struct(F.xxhash64("fp", F.lit(i)), "coarse"))["coarse"] for i in range(PIVOTS)]
        pivots = crowded.groupBy("cell").agg(F.concat(*sketch).alias("pivots"))
        made = stored(_voronoi(crowded, pivots, num, den), "voronoi")
        parts = made.groupBy("parent", "cell").agg(F.count("*").alias("part"))
        told = parts.groupBy("parent").agg(F.sum("part").alias("all"), F.max("part").alias("most")).withColumnRenamed("parent", "cell")
        told = stored(told.join(big, "cell").withColumn("split", (F.col("all") <= 2 * F.col("rows")) & (F.col("most") <= 0.8 * F.col("rows"))), "told")
        whole = told.where("not split").select("cell", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
        mine = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        pairs = _met(level, whole).withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        done = add(pairs.withColumn("cell", F.xxhash64("cell", F.least("mine", "theirs"), F.greatest("mine", "theirs"))))
        level = _met(made.withColumnRenamed("cell", "next").withColumnRenamed("parent", "cell"), told.where("split").select("cell"), "left_semi")
        level = level.drop("cell").withColumnRenamed("next", "cell").select(*columns)


def _near(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that the sizes and the fixed pivot family do not rule out."""
    side = lambda c: nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where((num * F.col("na") <= den * F.col("nb")) & (num * F.col("nb") <= den * F.col("na")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                classes = min(len(x), len(y))
                near.append(int(np.abs(_folded(x, classes) - _folded(y, classes)).sum()) * (den + num) <= (den - num) * (na + nb))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _recursed(rows: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components in a region that the coarse pivot family does not rule out.

    Rows of a region lie in order of size, so a row meets the ones after it until
    the window of sizes ends: first its next row, then the one after, for all
    regions at once. ``nearest`` gives each row only the one with the smallest bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 0, 50_000):
            cell, n, fp, label = (table.column(i).to_numpy() for i in range(4))
            sketch = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(len(cell), COARSE).astype(np.int16)
            bound, other = np.full(len(cell), np.inf), np.full(len(cell), -1)
            at, step = np.arange(len(cell)), 0
            while len(at):
                step += 1
                at = at[at + step < len(cell)]
                at = at[(cell[at] == cell[at + step]) & (num * n[at + step] <= den * n[at])]
                for lo in range(0, len(at), 8192):
                    i = at[lo : lo + 8192]
                    i = i[label[i] != label[i + step]]
                    j = i + step
                    gap, total = np.abs(sketch[i] - sketch[j]).sum(1, dtype=np.int64), n[i] + n[j]
                    hit = gap * (den + num) <= (den - num) * total
                    i, j, ratio = i[hit], j[hit], (gap / total)[hit]
                    if not len(i):
                        continue
                    if not nearest:
                        yield pa.RecordBatch.from_arrays([_long(np.minimum(fp[i], fp[j])), _long(np.maximum(fp[i], fp[j]))], names=["a", "b"])
                    for x, y in ((i, j), (j, i)):  # no row occurs twice in i, nor in j
                        better = ratio < bound[x]
                        bound[x[better]], other[x[better]] = ratio[better], y[better]
            if nearest:
                i = np.flatnonzero(other >= 0)
                x, y = fp[i], fp[other[i]]
                yield pa.RecordBatch.from_arrays([_long(np.minimum(x, y)), _long(np.maximum(x, y))], names=["a", "b"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "n", "fp").select("cell", "n", "fp", "label", "coarse")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _filter(keys: DataFrame, hashed: Column, rows: int) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of hashes: about 64 bits for each row, ``2 ** FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, max(10, int(rows * 64).bit_length()))
    got = bitmap(keys.select(hashed.alias("key")), "key", bits).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out, bits


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, width: int, num: int, den: int, salt: int, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose sets link, compared exactly.

    Sets are made again from the texts of the nodes in question, one for each node also where
    rows repeat an id. A bitmap of the
    ids of one row for each node lets the scan pass few other rows; the join on
    fingerprints drops those.
    """
    spark = docs.sparkSession
    wanted = stored(
        pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct().join(heads, "fp").select("fp", "_id"), "wanted"
    )
    count = wanted.count()
    wanted_ids, bits = _filter(wanted, F.xxhash64("_id"), count)
    sent = spark.sparkContext.broadcast(wanted_ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            mine = batch.filter(pa.array((sent.value[place >> 6] >> (place & 63)) & 1 == 1))
            for _, _, data, offsets in chunks(mine.column(1)):
                own = [s for s in shingle_sets(data, offsets, width) if len(s)]
                fp = pa.array([_fingerprint(s, salt)[0] for s in own], pa.int64())
                yield pa.RecordBatch.from_arrays([fp, pa.array([s.tobytes() for s in own], pa.binary())], names=["fp", "own"])

    made = docs.withColumn("p", F.shiftrightunsigned(F.xxhash64("_id"), 64 - bits)).mapInArrow(sets, "fp long, own binary")
    if repeats:
        made = made.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    joined = (
        pairs.join(made.select(F.col("fp").alias("a"), F.col("own").alias("sa")), "a").join(made.select(F.col("fp").alias("b"), F.col("own").alias("sb")), "b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", region: int = REGION, block: int = BLOCK
) -> DataFrame:
    """The component of every row under links of Jaccard similarity ``num / den`` or more.

    Returns (id_col, n_shingles, component_id), one row for each row of ``docs``.
    Words are what blanks ``[\\x20\\x09-\\x0D]`` part, A-Z lower-cased. Rows without
    words, null texts among them, have no shingles and are their own component. The
    component's id is the smallest id of its rows. Shingles are told apart by 64-bit
    hashes, sets by 128 bits. Rows that repeat an id, or have none, link by their own texts;
    a component is named by the smallest id present in it, and has a null one only if
    all its ids are null. Other columns are not read; an empty table gives an empty
    result. ``region`` and ``block`` bound what is compared at once and change no result.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must lie above 0 and not above 1")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    salt = 0
    while True:
        made = stored(_nodes(rows, width, salt), "nodes")
        grouped = made.where("fp is not null").groupBy("fp").agg(
            F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("coarse").alias("coarse"), F.min("other").alias("lo"), F.max("other").alias("hi")
        )
        nodes = stored(grouped, "sets")
        if nodes.where("lo <> hi").isEmpty():
            break
        salt += 1  # two sets with one name: other names for all
    members = made.where("n is not null").select("_id", "n", "fp")
    repeats = not members.groupBy("_id").count().where("count > 1").isEmpty()
    heads = nodes.select("fp", "_id")
    late = stored(made.where("shingle is not null").select("shingle").distinct(), "late")
    links = tested = labels = None
    before = float("inf")
    while True:
        order = _filter(late, F.col("shingle"), late.count())
        shared = stored(_shared(_regions(rows, width, num, den, order, salt)), "shared")
        star = _stars(shared, num, den)
        star = star if tested is None else star.join(tested, ["a", "b"], "left_anti")
        near = stored(_near(star, nodes, num, den), "near")
        tested = near if tested is None else tested.unionByName(near)
        fresh = stored(_verified(near, rows, heads, width, num, den, salt, repeats), "links")
        links = fresh if links is None else links.unionByName(fresh)
        labels = components(links)
        named = shared.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        counts = stored(named.select("cell", "label").distinct().groupBy("cell").agg(F.count("*").alias("k")).where("k > 1"), "labels")
        crowded = counts.where(F.col("k") > region).select(F.col("cell").alias("shingle"), "k").join(late, "shingle", "left_anti")
        crowded = stored(crowded, "crowded")
        held = crowded.agg(F.sum("k")).first()[0] or 0
        if not held or held > before / 2:
            break
        before, late = held, stored(late.unionByName(crowded.select("shingle")), "late")
    # Regions that still hold several components: nearest pairs first, as long as most of them link, then all that is left.
    nearest = True
    while True:
        rest = named.join(counts.select("cell"), "cell", "left_semi").join(nodes.select("fp", "coarse"), "fp")
        rest = _divided(stored(rest.select("cell", "fp", "n", "label", "coarse"), "rest"), num, den, region, block)
        more = _recursed(rest, num, den, nearest).join(tested, ["a", "b"], "left_anti")
        more = stored(_near(stored(more, "met"), nodes, num, den), "pairs")
        fresh = stored(_verified(more, rows, heads, width, num, den, salt, repeats), "links")
        tested = tested.unionByName(more)
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            labels = components(links)
        if not nearest:
            break
        nearest = 2 * fresh.count() > more.count()
        named = shared.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        counts = stored(named.select("cell", "label").distinct().groupBy("cell").agg(F.count("*").alias("k")).where("k > 1"), "labels")
    named = heads.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("_id").alias("component_id"))
    found = stored(named.join(least, "label").select("fp", "component_id"), "found")
    return members.join(found, "fp", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id")
    )
