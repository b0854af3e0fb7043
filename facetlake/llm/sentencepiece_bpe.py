"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A task cuts its texts into segments (blanks, then the characters up to the next
blank). No piece of the vocabulary crosses such a border, so equal segments get
equal ids and each distinct one is encoded once. Distinct segments lie in one
flat array of symbols. A round finds the best pair rank of each segment, merges
leftmost occurrences in all segments at once, and compacts the array; segments
without a pair leave it. Characters that the vocabulary lacks become their
UTF-8 bytes' pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import chunks, distinct_runs

SPACE = "▁"
NO_RANK = np.int64(1) << 60


class Vocabulary:
    """Pieces of a BPE model with identity normalisation, a space before each text, and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if [model.normalize(t) for t in ("\ufb01  A\u0301\t", " x ")] != [f"{SPACE}\ufb01{SPACE * 2}A\u0301\t", f"{SPACE * 2}x{SPACE}"]:
            raise ValueError("the model changes characters or blanks before it cuts them")
        size = model.vocab_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.id_of = {p: i for i, p in enumerate(pieces) if not special[i]}
        bytes_ = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id_of):
            raise ValueError("a piece crosses the border between words")
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int64)
        # Scores as ranks: 0 is best; equal scores share a rank.
        order = sorted({model.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        # Every split of a piece into two symbols is a pair; symbols may be pieces or lone characters.
        chars = sorted({c for p in self.id_of for c in p})
        self.chars = np.array([ord(c) for c in chars], np.int64)
        extra = [c for c in chars if c not in self.id_of]
        symbol = dict(self.id_of) | {c: size + k for k, c in enumerate(extra)}
        self.char_symbols = np.array([symbol[c] for c in chars], np.int64)
        self.size, self.first_char = size, size + len(extra)
        self.extra = np.array([ord(c) for c in extra], np.int64)
        found = {}
        for piece, to in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                if a is not None and b is not None:
                    found[(a << 32) | b] = (place[model.get_score(to)], to)
        keys = np.array(sorted(found), np.int64)
        self.pair_keys = keys
        self.pair_ranks = np.array([found[k][0] for k in keys.tolist()], np.int64)
        self.pair_to = np.array([found[k][1] for k in keys.tolist()], np.int64)
        # A merge is steady if no pair with its result is better: then all its occurrences can go at once.
        best = np.full(self.first_char + 1, NO_RANK)
        for k, (rank, _) in found.items():
            for s in (k >> 32, k & 0xFFFFFFFF):
                best[s] = min(best[s], rank)
        self.pair_steady = best[self.pair_to] > self.pair_ranks
        # Pieces' bytes for decoding, end to end.
        raw = [p.replace(SPACE, " ").encode() if not special[i] else b"" for i, p in enumerate(pieces)]
        for b, i in bytes_.items():
            raw[i] = bytes([b])
        raw[self.unk] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.cumsum([len(r) for r in raw])
        self.raw_starts = self.raw_ends - np.array([len(r) for r in raw])
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True

    # -- encoding ---------------------------------------------------------------

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """A symbol for each code point; unknown ones get a number of their own above all pieces."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, self.char_symbols[at], self.first_char + 1 + points)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK), at

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all segments, and the segment that each belongs to."""
        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
        done_symbols, done_words = [], []
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            rank, at = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                inside = np.flatnonzero(word[1:] == word[:-1])
                rank[inside], at[inside] = self._pairs(symbols[inside], symbols[inside + 1])
            lengths = np.diff(np.append(first, len(symbols)))
            low = np.repeat(np.minimum.reduceat(rank, first), lengths)
            live = low < NO_RANK
            if not live.all():  # segments without a pair leave
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, rank, low, at = symbols[live], word[live], rank[live], low[live], at[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == low)
            # Leftmost first: of overlapping hits in a row every second one; of an unsteady pair the first in its segment.
            run = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(word[hit], prepend=-1) != 0))
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 1
            head = np.diff(word[hit], prepend=-1) != 0
            steady = self.pair_steady[at[hit]]
            every = np.logical_and.reduceat(steady, np.flatnonzero(head))[np.cumsum(head) - 1]
            hit = hit[np.where(every, ~odd, head)]
            symbols = symbols.copy()
            symbols[hit] = self.pair_to[at[hit]]
            kept = np.ones(len(symbols), bool)
            kept[hit + 1] = False
            symbols, word = symbols[kept], word[kept]
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _final(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with characters outside the vocabulary spelt as bytes."""
        odd = symbols >= self.size
        if not odd.any():
            return symbols, word
        points = np.where(
            symbols[odd] > self.first_char,
            symbols[odd] - self.first_char - 1,
            self.extra[np.minimum(symbols[odd] - self.size, max(len(self.extra) - 1, 0))] if len(self.extra) else 0,
        )
        spelt = [chr(p).encode() for p in points.tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = [len(s) for s in spelt]
        ids = np.repeat(symbols, counts)
        ids[np.repeat(odd, counts)] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return ids, np.repeat(word, counts)

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk end to end, without begin and end, and each row's range."""
        # A space is put before each text that has one or more characters.
        sizes = np.diff(offsets)
        full = sizes > 0
        shifted = np.concatenate([[0], np.cumsum(sizes + full)])
        text = np.empty(shifted[-1], np.uint8)
        lead = np.zeros(len(text), bool)
        lead[shifted[:-1][full]] = True
        text[lead] = 32
        text[~lead] = data
        # The sign that stands for a space in pieces counts as a space itself.
        if (text == 0xE2).any():
            sign = np.flatnonzero((text[:-2] == 0xE2) & (text[1:-1] == 0x96) & (text[2:] == 0x81))
            if len(sign):
                text[sign] = 32
                gone = np.concatenate([sign + 1, sign + 2])
                kept = np.ones(len(text), bool)
                kept[gone] = False
                shifted = shifted - np.searchsorted(np.sort(gone), shifted)
                text = text[kept]
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        blank = text == 32
        fresh = blank.copy()
        fresh[1:] &= ~blank[:-1]
        fresh[shifted[:-1][shifted[:-1] < len(text)]] = True
        starts = np.flatnonzero(fresh)
        first, which = distinct_runs(text, starts)
        ends = np.append(starts[1:], len(text))
        # The distinct segments end to end, as code points.
        lens = (ends - starts)[first]
        at = np.repeat(starts[first] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        flat = text[at]
        points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = np.flatnonzero((flat & 0xC0) != 0x80)
        begin = np.searchsorted(heads, np.concatenate([[0], np.cumsum(lens)[:-1]]))
        points[points == 32] = ord(SPACE)
        ids, word = self._final(*self.merge(self._symbols(points), begin))
        bounds = np.searchsorted(word, np.arange(len(first) + 1))
        # Back to all segments in order.
        counts = np.diff(bounds)[which]
        stop = np.cumsum(counts)
        at = np.repeat(bounds[which] - (stop - counts), counts) + np.arange(stop[-1])
        return ids[at], np.concatenate([[0], stop])[np.searchsorted(starts, shifted)]

    # -- decoding ---------------------------------------------------------------

    def decode_rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the text that each row's ids stand for; ``bounds`` are the rows' places in ``ids``.

        Begin and end give nothing, the first space of a row goes, and runs of byte pieces
        that are no UTF-8 become replacement signs.
        """
        lens = (self.raw_ends - self.raw_starts)[ids]
        stop = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(self.raw_starts[ids] - stop[:-1], lens) + np.arange(stop[-1])
        raw = self.raw[at].tobytes()
        spelt = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        told = np.flatnonzero(lens > 0)  # pieces that say something
        first = np.searchsorted(told, bounds[:-1])
        out = []
        for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), strict=True):
            own = raw[stop[a] : stop[b]]
            if own[:1] == b" " and not self.is_byte[ids[told[k]]]:
                own = own[1:]
            if spelt[b] > spelt[a]:
                own = own.decode("utf-8", "replace").encode("utf-8")
            out.append(own)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One copy in each Python worker; the model file is read where the task runs."""
    return Vocabulary(path)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text; one row for each row of ``docs``.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256), and the ids themselves
    (array of int) and the decoded text with ``keep_ids``. Begin and end ids are
    included, so a null or empty text has two. The digests are of the ids as
    little-endian unsigned 32-bit numbers and of the decoded text in UTF-8. Other
    columns are not read; an empty table gives an empty result. ``model_path``
    must be readable on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1), 2 << 20):
                ids, bounds = vocab.encode_chunk(data, offsets)
                # Begin and end around every row's ids, end to end.
                rows = np.arange(end - row)
                full = bounds + 2 * np.arange(len(bounds))
                own = np.empty(full[-1], np.int64)
                inner = np.ones(len(own), bool)
                inner[full[:-1]] = inner[full[1:] - 1] = False
                own[inner], own[full[:-1]], own[full[1:] - 1] = ids, vocab.bos, vocab.eos
                counts, raw, cut = np.diff(full), own.astype("<u4").tobytes(), (4 * full).tolist()
                decoded = vocab.decode_rows(own, full)
                id_hex = [hashlib.sha256(raw[cut[i] : cut[i + 1]]).hexdigest() for i in rows.tolist()]
                text_hex = [hashlib.sha256(t).hexdigest() for t in decoded]
                out = [batch.column(0).slice(row, end - row), pa.array(counts, pa.int64()), pa.array(id_hex, pa.string()), pa.array(text_hex, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out += [pa.ListArray.from_arrays(pa.array(full.astype(np.int32)), pa.array(own.astype(np.int32))), pa.array([t.decode() for t in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
