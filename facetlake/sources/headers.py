"""Sizes and dates of images from the bytes around their pixels; nothing is decoded.

Spark's ``binaryFile`` source reads the files, so any store that Spark reaches will do; a bounded head and tail of each
go to Python. What a header does not say, or says beyond those bytes, is missing, never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import timestamps

#: Bytes of a file's head and tail that are looked at.
HEAD, TAIL = 1 << 18, 1 << 17
#: Tags of the directories, in the order in which a date is chosen, and the pointer to the inner directory.
ORIGINAL, DIGITIZED, CHANGED, INNER = 0x9003, 0x9004, 0x0132, 0x8769
#: Markers of a frame header, and markers without a length.
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xD9)}

Reader = Callable[[int, int], bytes]


def reader(head: bytes, tail: bytes, length: int) -> Reader:
    """``read(at, n)``: bytes of a file of which only the head and the tail are at hand; empty where they are not."""

    def read(at: int, n: int) -> bytes:
        if at < 0 or n < 0:
            return b""
        if at + n <= len(head):
            return head[at : at + n]
        start = at - (length - len(tail))
        return tail[start : start + n] if 0 <= start and start + n <= len(tail) else b""

    return read


def tags(tiff: bytes) -> dict[int, str]:
    """The dates in a TIFF directory and its inner one, in either byte order; what is broken is left out."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8 or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        return {}
    out: dict[int, str] = {}
    todo, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        (count,) = struct.unpack(order + "H", tiff[at : at + 2])
        for e in range(at + 2, min(at + 2 + 12 * count, len(tiff) - 11), 12):
            tag, kind, n, value = struct.unpack(order + "HHII", tiff[e : e + 12])
            if tag == INNER and kind == 4 and n == 1:
                todo.append(value)
            elif tag in (ORIGINAL, DIGITIZED, CHANGED) and kind == 2:
                start = e + 8 if n <= 4 else value
                text = tiff[start : start + n].split(b"\0")[0].decode("ascii", "replace").strip() if start + n <= len(tiff) else ""
                if text:
                    out.setdefault(tag, text)
    return out


def _jpeg(read: Reader) -> tuple[tuple[int, int], bytes]:
    at, exif = 2, b""
    while len(mark := read(at, 2)) == 2 and mark[0] == 0xFF:
        kind = mark[1]
        if kind == 0xFF:
            at += 1
            continue
        if kind in BARE:
            at += 2
            continue
        size = read(at + 2, 2)
        if len(size) < 2 or (n := struct.unpack(">H", size)[0]) < 2 or kind in (0xD9, 0xDA):
            break
        if kind in FRAMES:
            frame = read(at + 5, 4)
            return (struct.unpack(">HH", frame)[::-1] if len(frame) == 4 else (0, 0)), exif
        if kind == 0xE1 and not exif and read(at + 4, 6) == b"Exif\0\0":
            exif = read(at + 10, n - 8)
        at += 2 + n
    return (0, 0), exif


def _chunks(read: Reader, at: int, order: str, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of the data, size) of RIFF or PNG chunks, as far as their heads can be read."""
    png = order == ">"
    while at + 8 <= length and len(head := read(at, 8)) == 8:
        size = struct.unpack(order + "I", head[:4] if png else head[4:])[0]
        yield (head[4:] if png else head[:4]), at + 8, size
        at += 8 + size + (4 if png else size & 1)


def _png(read: Reader, length: int) -> tuple[tuple[int, int], bytes]:
    size, exif = (0, 0), b""
    for name, at, n in _chunks(read, 8, ">", length):
        if name == b"IHDR" and len(data := read(at, 8)) == 8:
            size = struct.unpack(">II", data)
        elif name == b"eXIf":
            exif = read(at, n)
            break
    return size, exif


def _webp(read: Reader, length: int) -> tuple[tuple[int, int], bytes]:
    size, exif = (0, 0), b""
    for name, at, n in _chunks(read, 12, "<", length):
        data = read(at, 10)
        if name == b"VP8X" and len(data) == 10:
            size = tuple(int.from_bytes(data[i : i + 3], "little") + 1 for i in (4, 7))
        elif name == b"VP8 " and size == (0, 0) and data[3:6] == b"\x9d\x01\x2a":
            size = tuple(v & 0x3FFF for v in struct.unpack("<HH", data[6:10]))
        elif name == b"VP8L" and size == (0, 0) and data[:1] == b"\x2f":
            bits = int.from_bytes(data[1:5], "little")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        elif name == b"EXIF":
            exif = read(at, n).removeprefix(b"Exif\0\0")
            break
    return size, exif


def header(head: bytes, tail: bytes, length: int) -> tuple[int, int, str | None]:
    """(width, height, date) of a JPEG, PNG, WebP or BMP file; (0, 0, None) where nothing can be told.

    The date is the text of the first that is there: when it was taken, when it was digitised, when it was changed.
    """
    read, size, exif = reader(head, tail, length), (0, 0), b""
    if head[:2] == b"\xff\xd8":
        size, exif = _jpeg(read)
    elif head[:8] == b"\x89PNG\r\n\x1a\n":
        size, exif = _png(read, length)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        size, exif = _webp(read, length)
    elif head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        size = (max(width, 0), abs(height))
    dates = tags(exif)
    width, height = size if 0 < min(size) and max(size) < 1 << 31 else (0, 0)
    return width, height, next((dates[t] for t in (ORIGINAL, DIGITIZED, CHANGED) if t in dates), None)


def read_headers(files: DataFrame) -> DataFrame:
    """(path, modified, width, height, taken) of rows (path, modificationTime, length, content) as ``binaryFile`` gives them.

    A file of another kind or cut off has width and height 0; ``taken`` is null without a date. Spark's source leaves out files of no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [header(h or b"", t or b"", n or 0) for h, t, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            width, height, taken = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(taken, pa.string())], names=["path", "modified", "width", "height", "taken"])

    size = F.length("content")
    tail = F.substring("content", F.greatest(size - TAIL, F.lit(0)) + 1, F.lit(TAIL))
    parts = files.select("path", F.col("modificationTime").alias("modified"), F.substring("content", F.lit(1), F.lit(HEAD)), tail, size.cast("long"))
    return parts.toDF("path", "modified", "head", "tail", "length").mapInArrow(run, "path string, modified timestamp, width int, height int, taken string")


def image_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) from the headers; (0, 0) where they cannot be read."""
    return read_headers(files).select("path", "width", "height")


def photo_dates(files: DataFrame) -> DataFrame:
    """(path, ts), in the order of time: the date in the file, else when the file was changed. A date that does not parse counts as none."""
    rows = read_headers(files).withColumn("date", F.nullif("taken", F.lit("")))
    dated = rows.select("path", timestamps(rows, ["date"], "modified").alias("ts"))
    return dated.where("ts IS NOT NULL").orderBy("ts", "path")
