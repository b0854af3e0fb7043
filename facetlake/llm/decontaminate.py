"""Benchmark decontamination by greedy string tiling.

Texts are cut into runs of letters and digits, lower-cased. A seed is ``tile``
tokens in a row, hashed with a running (Karp-Rabin) polynomial; items with fewer
tokens are one seed. Documents that share no seed with a test item are done
after one vectorised look-up. For the others, tokens of the text and of the item
are compared themselves, so a hash alone never makes a match. Matches begin
where the tokens before differ and run as far as the tokens are the same;
tiling marks the longest match of unmarked tokens, then the next, until none of
``tile`` tokens is left. Tiles may lie in any order, so a passage with its parts
rearranged is covered as well.

An item is looked up by its rare seeds only. Its most frequent seeds may be left out
as long as the tokens that they span do not reach the threshold: whatever covers the
item to the threshold then holds one of the others. So a template that many items
share pairs no document with all of them. Before tiling, the tokens that the common
seeds span have to reach the threshold too.

The test items are the stated query set: the driver holds all of them, in blocks of
about ``block_tokens`` tokens, and sends each block to the tasks; there is one pass
over the documents for each block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import SIGN_CLASS, chunks, tokens, windows

#: Letters and digits only: other signs part tokens.
LETTERS = (SIGN_CLASS == 1).astype(np.uint8)


def token_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, token hashes, starts, ends, row bounds) of chunks of lower-cased texts."""
    for row, _, data, offsets in chunks(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))):
        hashes, starts, ends, bounds = tokens(data, offsets, LETTERS)
        yield row, data, hashes, starts, ends, bounds


def matches(item: np.ndarray, text: np.ndarray, places: np.ndarray, there: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches (item place, text place, length) of at least ``tile`` equal tokens.

    ``places`` and ``there`` are where seeds of the item and the text may be equal, each
    in order of (seed, token before) and given as (seed code, place) arrays. A match
    begins where the tokens before differ, so seeds inside a match are never paired.
    """
    codes_i, at_i = places
    codes_t, at_t = there
    # The token before; none is like nothing else, and differs between item and text.
    before_i = np.where(at_i > 0, item[np.maximum(at_i - 1, 0)], -2)
    before_t = np.where(at_t > 0, text[np.maximum(at_t - 1, 0)], -3)
    order = np.lexsort((before_i, codes_i))
    codes_i, at_i, before_i = codes_i[order], at_i[order], before_i[order]
    low, high = np.searchsorted(codes_i, codes_t), np.searchsorted(codes_i, codes_t, "right")
    # Within a seed's places, those with the text's token before lie together: the ones around them begin a match.
    key = np.unique(np.concatenate([before_i, before_t]))
    rank_i, rank_t = np.searchsorted(key, before_i), np.searchsorted(key, before_t)
    names, group = np.unique(codes_i, return_inverse=True)
    joint = group * (len(key) + 1) + rank_i
    wanted = np.minimum(np.searchsorted(names, codes_t), max(len(names) - 1, 0)) * (len(key) + 1) + rank_t
    inner_low = np.clip(np.searchsorted(joint, wanted), low, high)
    inner_high = np.clip(np.searchsorted(joint, wanted, "right"), low, high)
    begins = []
    for a, b in ((low, inner_low), (inner_high, high)):
        n = b - a
        stop = np.cumsum(n)
        begins.append((np.repeat(a - (stop - n), n) + np.arange(n.sum()), np.repeat(at_t, n)))
    p = at_i[np.concatenate([x for x, _ in begins])]
    t = np.concatenate([x for _, x in begins])
    # As far as the tokens are the same.
    length, alive = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(alive):
        i, j = p[alive] + length[alive], t[alive] + length[alive]
        alive = alive[(i < len(item)) & (j < len(text))]
        i, j = p[alive] + length[alive], t[alive] + length[alive]
        alive = alive[item[i] == text[j]]
        length[alive] += 1
    kept = length >= tile
    return p[kept], t[kept], length[kept]


def tiles(item: np.ndarray, text: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, text place, length) from the longest matches.

    Longest first, then the earliest in the item and in the text.
    """
    p, t, n = found
    order = np.lexsort((t, p, -n))
    whole = zip((-n[order]).tolist(), p[order].tolist(), t[order].tolist(), strict=True)
    marked_item, marked_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out, parts, left = [], [], len(item)
    ahead = next(whole, None)
    while left >= tile and (ahead or parts):
        # Parts of matches and whole matches in one order.
        if parts and (ahead is None or parts[0] < ahead):
            n, p, t = heapq.heappop(parts)
        else:
            (n, p, t), ahead = ahead, next(whole, None)
        taken = marked_item[p : p - n] | marked_text[t : t - n]
        if not taken.any():
            marked_item[p : p - n] = True
            marked_text[t : t - n] = True
            left += n
            out.append((p, t, -n))
            continue
        # What is left of the match between marked tokens.
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= tile:
                heapq.heappush(parts, (a - b, p + a, t + a))
    return out


class Tests:
    """Test items as numbers of their tokens, and their seeds, sorted.

    ``names`` numbers the items' distinct tokens. An item's seeds are as wide as the
    tile, or as the item where that is shorter.
    """

    def __init__(self, ids: list, items: list[tuple[list[bytes], np.ndarray]], tile: int):
        self.ids, self.tile = ids, tile
        self.names: dict[bytes, int] = {}
        self.items = [np.array([self.names.setdefault(w, len(self.names)) for w in ws], np.int64) for ws, _ in items]
        self.seeds = [windows(h, min(tile, len(h))) for _, h in items]
        self.widths = sorted({min(tile, len(x)) for x in self.items})
        self.by_width = {}
        for width in self.widths:
            owners = [k for k, x in enumerate(self.items) if min(tile, len(x)) == width]
            owner = np.repeat(owners, [len(self.seeds[k]) for k in owners])
            codes = np.concatenate([self.seeds[k] for k in owners])
            pairs = np.unique(np.stack([codes, owner.astype(np.uint64)]), axis=1)
            self.by_width[width] = pairs[0], pairs[1].astype(np.int64)

    def rare(self, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By width, the seeds (codes in order, owners) of which a text has one if it covers an item to ``threshold``.

        Of an item's seeds that other items share too, the most frequent are left out while the tokens that
        those left out span stay below the threshold.
        """
        out = {}
        for width, (codes, owners) in self.by_width.items():
            names, at, n = np.unique(codes, return_inverse=True, return_counts=True)
            kept = np.ones(len(codes), bool)
            common = np.flatnonzero(n[at] > 1)
            order = common[np.lexsort((codes[common], -n[at[common]], owners[common]))]
            for k in np.split(order, np.flatnonzero(np.diff(owners[order])) + 1) if len(order) else []:
                item = int(owners[k[0]])
                size, spanned = len(self.items[item]), np.zeros(len(self.items[item]), bool)
                places = np.argsort(self.seeds[item], kind="stable")
                own = self.seeds[item][places]
                for i in k.tolist():
                    low, high = np.searchsorted(own, codes[i]), np.searchsorted(own, codes[i], "right")
                    more = spanned.copy()
                    for p in places[low:high].tolist():
                        more[p : p + width] = True
                    if more.sum() < threshold * size:
                        spanned, kept[i] = more, False
            out[width] = codes[kept], owners[kept]
        return out

    def found(self, texts: pa.Array, threshold: float, rare: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) of rows that may cover an item to ``threshold``; ``rare`` are the seeds for it."""
        for first, data, hashes, starts, ends, bounds in token_chunks(texts):
            hits = [self._hits(windows(hashes, w), w, bounds, rare[w]) for w in self.widths]
            hits = [h for h in hits if h is not None]
            if not hits:
                continue
            pairs = np.unique(np.concatenate(hits, axis=1), axis=1)
            last, text, codes = -1, None, {}
            for r, k in pairs.T.tolist():
                if r != last:
                    text, codes, last = None, {}, r
                width = min(self.tile, len(self.items[k]))
                if width not in codes:
                    codes[width] = windows(hashes[bounds[r] : bounds[r + 1]], width)
                code, seeds = codes[width], self.seeds[k]
                names = np.sort(seeds)
                same = names[np.minimum(np.searchsorted(names, code), len(names) - 1)] == code
                edges = np.zeros(len(self.items[k]) + 1, np.int64)
                have = np.flatnonzero(np.isin(seeds, code[same]))
                np.add.at(edges, have, 1)
                np.add.at(edges, have + width, -1)
                if (edges.cumsum()[:-1] > 0).sum() < threshold * len(self.items[k]):
                    continue
                if text is None:
                    own = slice(bounds[r], bounds[r + 1])
                    zero = starts[own][0]
                    raw = data[zero : ends[own][-1]].tobytes()
                    text = np.array([self.names.get(raw[x:y], -1) for x, y in zip((starts[own] - zero).tolist(), (ends[own] - zero).tolist(), strict=True)], np.int64)
                place = np.flatnonzero(same)
                found = matches(self.items[k], text, (seeds, np.arange(len(seeds))), (code[place], place), width)
                yield first + r, k, tiles(self.items[k], text, found, width)

    def _hits(self, codes: np.ndarray, width: int, bounds: np.ndarray, rare: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
        """(row, item) of the text's seeds that are among the rare ones of an item, as two rows of an array."""
        known, owners = rare
        if not len(codes) or not len(known):
            return None
        low = np.searchsorted(known, codes)
        hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == codes)
        row = np.searchsorted(bounds, hit, "right") - 1
        inside = hit + width <= bounds[row + 1]
        hit, row = hit[inside], row[inside]
        if not len(hit):
            return None
        # A seed that a row repeats counts once.
        row, at = np.unique(np.stack([row, low[hit]]), axis=1)
        n = np.searchsorted(known, known[at], "right") - at
        stop = np.cumsum(n)
        return np.stack([np.repeat(row, n), owners[np.repeat(at - (stop - n), n) + np.arange(stop[-1])]])


def load_tests(benchmark: DataFrame, tile: int = 5, block_tokens: int = 4_000_000, id_col: str = "item_id", text_col: str = "text") -> list[Tests]:
    """The items in blocks of about ``block_tokens`` tokens; the driver holds all blocks.

    An item with fewer than ``tile`` tokens is matched as a whole; one without a token, or with a null text, matches nothing.
    """
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # A token and the sign after it take two bytes at least.
    bytes_ = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-int(bytes_) // (2 * block_tokens)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        own = dealt.where(F.col("block") == block).drop("block").toArrow()
        ids, items = own.column(0).to_pylist(), []
        for _, data, hashes, starts, ends, bounds in token_chunks(own.column(1)):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                items.append(([data[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], hashes[a:b]))
        kept = [(i, x) for i, x in zip(ids, items, strict=True) if x[0]]
        if kept:
            out.append(Tests([i for i, _ in kept], [x for _, x in kept], tile))
    return out


def contaminated(docs: DataFrame, tests: list[Tests], threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_type: str = "long") -> DataFrame:
    """Pairs of a document and a test item that its text covers to ``threshold`` or more.

    Returns (id_col, item_id, covered_tokens, item_tokens, coverage, tiles); a tile
    is (item_start, doc_start, length) in tokens. Null and empty texts have no
    pairs; equal items give a pair each; rows that repeat are rows of their own.
    Other columns are not read; a column of ``docs`` named like one of the result is
    no hindrance. No tests or no documents give an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_type}, covered_tokens long, item_tokens long, coverage double, tiles array<struct<item_start:long,doc_start:long,length:long>>"
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    if not tests:
        return docs.sparkSession.createDataFrame([], schema)

    def one(block: Tests) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast((block, block.rare(threshold)))
        tile_type = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests, rare = sent.value
            for batch in batches:
                out = []
                for row, k, found in tests.found(batch.column(1), threshold, rare):
                    covered, size = sum(n for _, _, n in found), len(tests.items[k])
                    if covered >= threshold * size:
                        parts = [{"item_start": p, "doc_start": t, "length": n} for p, t, n in sorted(found)]
                        out.append((row, tests.ids[k], covered, size, covered / size, parts))
                if out:
                    at, items, covered, sizes, share, parts = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(items), pa.array(covered, pa.int64()), pa.array(sizes, pa.int64()), pa.array(share), pa.array(parts, tile_type)],
                        names=[id_col, "item_id", "covered_tokens", "item_tokens", "coverage", "tiles"],
                    )

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [one(b) for b in tests])


def clean(docs: DataFrame, tests: list[Tests], threshold: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that no test item contaminates."""
    place = docs.columns.index(text_col)

    def one(rows: DataFrame, block: Tests) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast((block, block.rare(threshold)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests, rare = sent.value
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, k, found in tests.found(batch.column(place), threshold, rare):
                    if sum(n for _, _, n in found) >= threshold * len(tests.items[k]):
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    return reduce(one, tests, docs)
