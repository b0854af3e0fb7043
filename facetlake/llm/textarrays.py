"""Numpy views of Arrow text columns: chunks, words and their hashes.

These helpers work inside tasks, a chunk of rows at a time, so that memory
depends on ``MAX_BYTES`` or on one text, whichever is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 1 << 20
#: Runs of more bytes are hashed by the standard library.
LONG_RUN = 512
#: An odd multiplier for the places of a sequence, and mixing constants (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all input bits over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h = h ^ (h >> np.uint64(29))
    h = h * MIX[1]
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, byte offsets) of runs of rows; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def token_starts(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the class of bytes changes or a row begins: starts of runs of one class."""
    if not len(classes):
        return np.zeros(0, np.int64)
    fresh = np.empty(len(classes), bool)
    fresh[0] = True
    np.not_equal(classes[1:], classes[:-1], out=fresh[1:])
    inner = offsets[:-1]
    fresh[inner[inner < len(classes)]] = True
    return np.flatnonzero(fresh)


def run_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs cover ``data``.

    Eight bytes at a time are mixed into the state, which starts from the length. Each step
    is a bijection, so runs of one length up to eight bytes never clash; others do by chance
    alone. Where equality decides a result, callers compare the bytes (``same_runs``).
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    state = mixed(lengths.astype(np.uint64) * BASE)
    done, alive = 0, np.flatnonzero(lengths <= LONG_RUN)
    while len(alive):
        left = lengths[alive] - done
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        state[alive] = mixed((state[alive] ^ (eights[starts[alive] + done] & mask)) * BASE)
        done += 8
        alive = alive[left > 8]
    for i in np.flatnonzero(lengths > LONG_RUN).tolist():
        run = data[starts[i] : starts[i] + lengths[i]].tobytes()
        state[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")
    return state


def same_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether run i holds the same bytes as run ``first[i]``."""
    lengths = ends - starts
    same = lengths == lengths[first]
    told = np.flatnonzero(same & (first != np.arange(len(first))) & (lengths > 0))
    if len(told):
        sizes = lengths[told]
        stop = np.cumsum(sizes)
        place = np.arange(stop[-1]) - np.repeat(stop - sizes, sizes)
        equal = data[np.repeat(starts[told], sizes) + place] == data[np.repeat(starts[first[told]], sizes) + place]
        same[told] = np.logical_and.reduceat(equal, stop - sizes)
    return same


def distinct_runs(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One run for each distinct content, and for each run the place of its content in that list.

    Equal hashes only say which runs to compare: bytes decide. Runs cover ``data``.
    """
    ends = np.append(starts[1:], len(data))[: len(starts)]
    hashes = run_hashes(data, starts) if hashes is None else hashes
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_runs(data, starts, ends, first[which]))
    if len(odd):  # clashes: told apart by their bytes
        more: dict[bytes, int] = {}
        which = which.copy()
        heads = first.tolist()
        for i in odd.tolist():
            run = data[starts[i] : ends[i]].tobytes()
            if run not in more:
                more[run] = len(heads)
                heads.append(i)
            which[i] = more[run]
        first = np.array(heads)
    return first, which


#: 1 for bytes of words ``[^\x20\x09-\x0D]``, 0 for blanks.
WORD_CLASS = np.ones(256, np.uint8)
WORD_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
#: Blanks 0, letters, digits and bytes of longer characters 1, other signs 2.
SIGN_CLASS = WORD_CLASS * 2
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    SIGN_CLASS[_lo:_hi] = 1


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one non-blank class: hashes, starts, ends, and for each row its range of tokens."""
    classes = table[data]
    starts = token_starts(classes, offsets)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    hashes = run_hashes(data, starts)
    kept = classes[starts] != 0
    starts, ends, hashes = starts[kept], ends[kept], hashes[kept]
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` tokens in a row; starts at each token that has enough after it."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = powers(width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * step[k + 1]
    return mixed(total)
