"""Language identification by interpolated Kneser-Ney character models.

Characters are lower-cased letters as they are; whatever is no letter is a border.
Grams of up to four letters are counted over all training rows and summed in
Spark, so the model grows with the text that it saw; ``max_grams`` refuses a model
that is too large to send to the tasks, before anything is gathered.

Each order is a sorted array of 64-bit gram hashes with a matrix of log probabilities,
one column for each language, fully interpolated at training. Scoring looks
grams up by binary search and backs off where no language saw the gram. A tenth
of the training rows is kept out of the counts: their cross-entropies
calibrate the limit beyond which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .textarrays import chunks, mixed

UNKNOWN = "und"
#: Bits of a code point; odd multipliers for the places of a gram (fixed values).
BITS = 21
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Held out of the counts for calibration: one row of so many. Share of them that is accepted, and slack above it.
HELD_OUT, ACCEPTED, SLACK = 10, 0.999, 1.2


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """The lower-case letter of each code point; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def signs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a chunk's rows, each row with one border (0) before it and after it, and row bounds.

    Several characters in a row that are no letters are one border. Bytes that are no UTF-8 are borders as well.
    """
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.cumsum((data & 0xC0) != 0x80)
        bounds = np.concatenate([[0], heads])[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *[len(t) for t in texts]])
    rows = len(offsets) - 1
    out = np.zeros(len(points) + 2 * rows, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    out[np.arange(len(points)) + 2 * row + 1] = _fold()[points]
    ends = bounds + 2 * np.arange(rows + 1)
    kept = np.ones(len(out), bool)
    kept[1:] = (out[1:] != 0) | (out[:-1] != 0)
    kept[ends[:-1]] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    return out[kept], place[ends]


def _before(symbols: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The sign at each place and those 1, 2, ... places before it; signs before a row are borders."""
    place = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [symbols]
    for k in range(1, order):
        shifted = np.zeros_like(symbols)
        shifted[k:] = symbols[:-k]
        out.append(np.where(place >= k, shifted, 0))
    return out


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each row's gram; the columns are its signs, the last one first."""
    total = np.zeros(len(columns[0]), np.uint64)
    for k, column in enumerate(columns):
        total += (column.astype(np.uint64) + np.uint64(1)) * PLACES[k]
    return mixed(total)


class Sorted:
    """A sorted array of hashes. As they are spread evenly, their leading bits say about where one lies."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = max(1, len(codes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __len__(self) -> int:
        return len(self.codes)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the array, and which of the wanted hashes are there."""
        last = len(self.codes) - 1
        at = np.minimum(self.starts[(wanted >> self.shift).astype(np.int64)], last)
        there = self.codes[at]
        found = there == wanted
        left = np.flatnonzero(there < wanted)
        while len(left):
            left = left[at[left] < last]
            at[left] += 1
            there = self.codes[at[left]]
            found[left] = there == wanted[left]
            left = left[there < wanted[left]]
        return at, found


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of a few columns of code points, and how often each occurs."""
    top = max(int(c.max()) for c in columns) + 1
    seen = np.zeros(top, bool)
    for c in columns:
        seen[c] = True
    letters = np.flatnonzero(seen)
    rank = np.zeros(top, np.uint64)
    rank[letters] = np.arange(len(letters))
    bits = max(1, (len(letters) - 1).bit_length())
    if bits * len(columns) > 64:  # more letters than four fit into 64 bits
        rows, counts = np.unique(np.stack(columns), axis=1, return_counts=True)
        return list(rows), counts
    code = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        code |= rank[c] << np.uint64(bits * k)
    code, counts = np.unique(code, return_counts=True)
    mask = np.uint64((1 << bits) - 1)
    return [letters[(code >> np.uint64(bits * k) & mask).astype(np.int64)] for k in range(len(columns))], counts


@dataclass
class Model:
    """``grams[k]``: sorted hashes of k+1 signs; ``logp[k]``: their log probabilities by language.

    ``contexts[k]``, ``backoff[k]``: sorted hashes of k+1 signs and the log weight
    that each language leaves to the shorter gram. ``floor``: of a sign never seen. ``spread``: how many signs
    the shortest gram is mixed over, all unseen ones counting as one.
    """

    languages: list[str]
    order: int
    grams: list[Sorted] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[Sorted] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    spread: int = 1
    limit: float = float("inf")

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of each sign after those before it, by language; ``columns`` as ``_before`` gives them."""
        return self._lookup(columns[: self.order])

    def _lookup(self, columns: list[np.ndarray]) -> np.ndarray:
        k = len(columns) - 1
        at, found = self.grams[k].find(hashed(columns))
        out = self.logp[k][at]
        missing = np.flatnonzero(~found)
        if len(missing):
            if k == 0:
                out[missing] = self.floor
                return out
            lost = [c[missing] for c in columns]
            where, known = self.contexts[k - 1].find(hashed(lost[1:]))
            out[missing] = self._lookup(lost[:-1]) + np.where(known[:, None], self.backoff[k - 1][where], 0)
        return out


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Absolute discount of each language from its grams seen once and twice."""
    once, twice = (counts == 1).sum(0), (counts == 2).sum(0)
    return np.clip(np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, the first row of each, and the sums of their values by language."""
    codes, first, row = np.unique(codes, return_index=True, return_inverse=True)
    out = np.zeros((len(codes), values.shape[1]))
    np.add.at(out, row, values)
    return codes, first, out


def kneser_ney(languages: list[str], order: int, columns: list[np.ndarray], language: np.ndarray, counts: np.ndarray) -> Model:
    """The interpolated model from counts of full-order grams (signs, the last one first; language index; count).

    Shorter grams count the distinct signs seen before them instead of their own
    occurrences; the shortest is mixed with an even spread over all signs.
    """
    model = Model(languages, order, spread=len(np.unique(np.concatenate(columns))) + 1)
    table = np.zeros((len(counts), len(languages)))
    table[np.arange(len(counts)), language] = counts
    codes, first, table = _summed(hashed(columns), table)
    tables = {order: (codes, [c[first] for c in columns], table)}
    for n in range(order - 1, 0, -1):
        _, longer, values = tables[n + 1]
        codes, first, kept = _summed(hashed(longer[:n]), (values > 0).astype(float))
        tables[n] = (codes, [c[first] for c in longer[:n]], kept)
    for n in range(1, order + 1):
        codes, own, values = tables[n]
        discount = _discounts(values)
        history = hashed(own[1:]) if n > 1 else np.zeros(len(codes), np.uint64)
        context, row = np.unique(history, return_inverse=True)
        total, types = np.zeros((2, len(context), len(languages)))
        np.add.at(total, row, values)
        np.add.at(types, row, (values > 0).astype(float))
        left = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        if n == 1:
            below = np.full((len(codes), len(languages)), 1 / model.spread)
            model.floor = np.log(np.maximum(left[0] / model.spread, 1e-12)).astype(np.float32)
        else:
            below = np.exp(model._lookup(own[: n - 1]))
            model.contexts.append(Sorted(context))
            model.backoff.append(np.log(np.maximum(left, 1e-12)).astype(np.float32))
        p = np.maximum(values - discount, 0) / np.maximum(total[row], 1) + left[row] * below
        model.grams.append(Sorted(codes))
        model.logp.append(np.log(p).astype(np.float32))
    return model


def count_grams(docs: DataFrame, order: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, first, rest, n): counts of full-order grams over all rows with a language.

    ``rest`` holds the code points of the last three signs, ``first`` that of the one before. Each task sums its own rows first and sends one row for each gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[np.ndarray], np.ndarray]] = {}
        for batch in batches:
            order_by = batch.column(1).to_numpy(zero_copy_only=False)
            for lang in np.unique(order_by.astype(str)):
                own = batch.column(0).filter(pa.array(order_by == lang))
                parts = [sums[lang]] if lang in sums else []
                for _, _, data, offsets in chunks(own):
                    symbols, bounds = signs(data, offsets)
                    inner = np.ones(len(symbols), bool)
                    inner[bounds[:-1]] = False  # the border before a row is given, not predicted
                    if inner.any():
                        parts.append(_counted([c[inner] for c in _before(symbols, bounds, order)]))
                if parts:
                    sums[lang] = _merged(parts)
        for lang, (columns, counts) in sums.items():
            rest, first = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for k, c in enumerate(columns[:3]):
                rest |= c.astype(np.int64) << (BITS * k)
            if len(columns) > 3:
                first = columns[3].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(first), pa.array(rest), pa.array(counts, pa.int64())], names=["lang", "first", "rest", "n"]
            )

    def _merged(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(order)]
        codes, first, row = np.unique(hashed(columns), return_index=True, return_inverse=True)
        return [c[first] for c in columns], np.bincount(row, np.concatenate([p[1] for p in parts])).astype(np.int64)

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    partial = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, first long, rest long, n long")
    return partial.groupBy("lang", "first", "rest").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = 4, text_col: str = "text", lang_col: str = "lang", max_languages: int = 256, max_grams: int = 20_000_000) -> Model:
    """Counts all rows that have a language and a text but one in ``HELD_OUT``, and fits one model for each language.

    More languages or grams than the model may have are an error, found before they are gathered;
    a lower ``order`` has fewer grams. The rows that were held out set the rejection limit.
    """
    if not 1 <= order <= len(PLACES):
        raise ValueError(f"order must be 1 to {len(PLACES)}")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    fold = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT))
    counted = stored(count_grams(rows.where(fold != 0), order), "grams")
    sizes = counted.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages or sum(r["n"] for r in sizes) > max_grams:
        raise ValueError(f"{len(sizes)} languages with {sum(r['n'] for r in sizes)} grams: the model is sized for {max_languages} and {max_grams}")
    if not sizes:
        return Model([], order)
    languages = sorted(r["lang"] for r in sizes)
    table = counted.toArrow()
    index = {lang: i for i, lang in enumerate(languages)}
    which = np.array([index[x] for x in table.column("lang").to_pylist()])
    rest = table.column("rest").to_numpy()
    columns = [rest >> (BITS * k) & ((1 << BITS) - 1) for k in range(min(order, 3))] + [table.column("first").to_numpy()] * (order > 3)
    model = kneser_ney(languages, order, columns, which, table.column("n").to_numpy())
    own = entropies(rows.where(fold == 0), model)
    reach = own.agg(F.percentile_approx("own", ACCEPTED, 10_000)).first()[0]
    if reach is not None:
        model.limit = float(reach) * SLACK
    return model


def _costs(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy for each sign of every row of a chunk by language, and whether the row has a letter."""
    symbols, bounds = signs(data, offsets)
    letters = np.add.reduceat(symbols != 0, bounds[:-1]) > 0
    logp = model.log_probabilities(_before(symbols, bounds, model.order))
    logp[bounds[:-1]] = 0
    sums = np.add.reduceat(logp, bounds[:-1], axis=0, dtype=np.float64)
    return -sums / np.maximum(np.diff(bounds) - 1, 1)[:, None], letters


def entropies(rows: DataFrame, model: Model) -> DataFrame:
    """``own``: the cross-entropy of every text (text, lang) under its own language, null without a letter or a model of it."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        index = {lang: i for i, lang in enumerate(m.languages)}
        for batch in batches:
            which = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], int)
            for row, end, data, offsets in chunks(batch.column(0)):
                cost, letters = _costs(m, data, offsets)
                mine = which[row:end]
                yield pa.RecordBatch.from_arrays([pa.array(cost[np.arange(end - row), mine], mask=~letters | (mine < 0))], names=["own"])

    return rows.select("text", "lang").mapInArrow(run, "own double")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text; one row for each row of ``docs``.

    Returns (id_col, lang_pred, score, entropy, rejected). The language with the
    lowest cross-entropy for each sign wins, the first by name among equals;
    ``score`` is its share of ``exp(-16 * entropy)``, ``rejected`` tells that even
    the best cross-entropy is above the calibrated limit. A null text, a text
    without a letter, and any text if no language was learned give ``und``, score
    0 and a null entropy. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                best = np.full(end - row, len(m.languages))
                score, entropy = np.zeros(end - row), np.full(end - row, np.nan)
                if m.languages:
                    cost, letters = _costs(m, data, offsets)
                    low = cost.argmin(1)
                    best = np.where(letters, low, best)
                    lowest = cost.min(1)
                    share = 1 / np.exp(-16 * (cost - lowest[:, None])).sum(1)
                    score, entropy = np.where(letters, share, 0.0), np.where(letters, lowest, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(names[best], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(entropy, pa.float64(), mask=np.isnan(entropy)),
                        pa.array(np.nan_to_num(entropy) > m.limit),
                    ],
                    names=[id_col, "lang_pred", "score", "entropy", "rejected"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double, entropy double, rejected boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
