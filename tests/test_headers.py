"""Sizes and dates from made headers: both byte orders, every kind of file, and broken ones."""

import datetime
import os
import struct
import zlib

import numpy as np

from facetlake.functions import boxes, pixels
from facetlake.sources.headers import header, image_sizes, photo_dates, tags


def tiff(order, outer, inner=()):
    """A directory of texts by tag, and an inner one behind it."""
    mark, data = {"<": b"II", ">": b"MM"}[order], b""
    entries = [*outer.items(), *([(0x8769, None)] if inner else [])]
    at = 8 + 2 + 12 * len(entries) + 4

    def directory(items, base):
        out, rest = struct.pack(order + "H", len(items)), b""
        end = base + 2 + 12 * len(items) + 4
        for tag, text in items:
            if text is None:
                out += struct.pack(order + "HHII", tag, 4, 1, place)
                continue
            raw = text.encode() + b"\0"
            value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", end + len(rest))
            out += struct.pack(order + "HHI", tag, 2, len(raw)) + value
            rest += raw if len(raw) > 4 else b""
        return out + struct.pack(order + "I", 0) + rest

    place = 0
    place = 8 + len(directory(entries, 8))
    data = directory(entries, 8)
    assert at <= 8 + len(data)
    return mark + struct.pack(order + "HI", 42, 8) + data + (directory(list(dict(inner).items()), place) if inner else b"")


def jpeg(width, height, exif=b"", before=b""):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif if exif else b""
    return b"\xff\xd8" + before + app + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0" + b"\xff\xda\0\x02pixels\xff\xd9"


def png(width, height, exif=b"", pixels_=None):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + row.tobytes() for row in (np.zeros((height, width, 3), np.uint8) if pixels_ is None else pixels_))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def webp(kind, width, height, exif=b"", filler=0):
    part = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    if kind == "VP8X":
        body = part(b"VP8X", b"\x08\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")) + part(b"VP8 ", b"x" * (filler + 9))
    elif kind == "VP8 ":
        body = part(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width | 1 << 14, height))
    else:
        body = part(b"VP8L", b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + b"rest of it")
    body += part(b"EXIF", b"Exif\0\0" + exif) if exif else b""
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def of(data, head=1 << 18, tail=1 << 17):
    return header(data[:head], data[-tail:] if data else b"", len(data))


DATE = "2024:06:15 09:00:00"


def test_dates_in_either_byte_order():
    for order in "<>":
        assert tags(tiff(order, {0x0132: DATE}, {0x9003: "2020:01:02 03:04:05", 0x9004: "2021:01:01 00:00:00"})) == {0x0132: DATE, 0x9003: "2020:01:02 03:04:05", 0x9004: "2021:01:01 00:00:00"}
        assert of(jpeg(640, 480, tiff(order, {0x0132: DATE}, {0x9004: "2021:01:01 00:00:00"}))) == (640, 480, "2021:01:01 00:00:00")
        assert of(png(3, 2, tiff(order, {0x0132: DATE}))) == (3, 2, DATE)
        assert of(webp("VP8X", 4000, 3000, tiff(order, {0x9003: DATE}))) == (4000, 3000, DATE)
        assert tags(tiff(order, {0x0132: "abc"})) == {0x0132: "abc"}


def test_sizes_of_every_kind():
    assert of(webp("VP8 ", 300, 200)) == (300, 200, None) and of(webp("VP8L", 16383, 5)) == (16383, 5, None)
    assert of(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9) + b"\0" * 30) == (7, 9, None)
    assert of(jpeg(9, 8, before=b"\xff\xe0\0\x10" + b"J" * 14)) == (9, 8, None)
    # The date stands behind the pixels, out of the head's reach.
    assert of(webp("VP8X", 40, 30, tiff("<", {0x9003: DATE}), 5000), 100, 400) == (40, 30, DATE)


def test_broken_headers():
    """Every way to cut a file short, and random bytes in it: never an error, and sizes that are there or 0."""
    rng = np.random.default_rng(1)
    for whole in (jpeg(640, 480, tiff("<", {0x0132: DATE}, {0x9003: DATE})), png(30, 20, tiff(">", {0x0132: DATE})), webp("VP8X", 40, 30, tiff("<", {0x9003: DATE}))):
        size = of(whole)[:2]
        for cut in range(len(whole)):
            assert of(whole[:cut])[:2] in (size, (0, 0))
        for _ in range(300):
            data = bytearray(whole)
            for at in rng.integers(0, len(data), 3):
                data[at] = rng.integers(256)
            of(bytes(data))
    loop = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 8)
    assert tags(loop) == {} and of(b"") == (0, 0, None) and of(b"text") == (0, 0, None)


def test_tables_of_sizes_and_dates(spark, tmp_path):
    files = {
        "a.jpg": jpeg(640, 480, tiff("<", {}, {0x9003: DATE})),
        "b.png": png(30, 20),
        "c.webp": webp("VP8X", 40, 30, tiff(">", {0x0132: "2024-06-14 08:00:00"})),
        "d.jpg": jpeg(5, 5, tiff("<", {0x0132: "yesterday"})),
        "e.jpg": b"not an image",
    }
    stamp = datetime.datetime(2024, 6, 16, tzinfo=datetime.UTC).timestamp()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (stamp, stamp))
    read = spark.read.format("binaryFile").load(str(tmp_path))
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r.path): (r.width, r.height) for r in image_sizes(read).collect()} == {"a.jpg": (640, 480), "b.png": (30, 20), "c.webp": (40, 30), "d.jpg": (5, 5), "e.jpg": (0, 0)}
    dates = [(name(r.path), r.ts.strftime("%m-%d %H")) for r in photo_dates(read).collect()]
    assert [d[0] for d in dates] == ["c.webp", "a.jpg", "b.png", "d.jpg", "e.jpg"] and dates[0][1] == "06-14 08" and dates[1][1] == "06-15 09"
    assert image_sizes(read.limit(0)).collect() == []


def test_scaled_images(spark, tmp_path):
    """Area means against a plain sum over the covered parts, and boxes that go along; Spark's own reader decodes the file."""
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (7, 10, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(10, 7, pixels_=rgb))
    images = spark.read.format("image").load(str(tmp_path)).selectExpr("image.origin AS key", "image")
    images = images.union(spark.sql("SELECT 'bad', CAST(NULL AS struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>)"))
    got = {r.key[-5:]: r for r in pixels.scaled_images(images, "key", 4).collect()}
    assert got["bad"].image is None and got["bad"].scale_x is None
    small = got["a.png"].image
    assert (small.width, small.height) == (4, 2) == pixels.fitted(10, 7, 4)
    out = np.frombuffer(bytes(small.data), np.uint8).reshape(2, 4, 3)[:, :, ::-1]
    for y in range(2):
        for x in range(4):
            over = lambda a, b, n, k: max(0, min((k + 1) * a / b, n + 1) - max(k * a / b, n))
            want = sum(over(7, 2, i, y) * over(10, 4, j, x) * rgb[i, j].astype(float) for i in range(7) for j in range(10)) / (7 / 2 * 10 / 4)
            assert np.abs(out[y, x] - want).max() <= 0.5 + 1e-9
    box = spark.sql("SELECT named_struct('top', 3, 'right', 9, 'bottom', 7, 'left', 2) AS b, 0.4D AS x, 0.25D AS y, CAST(NULL AS DOUBLE) AS z")
    from pyspark.sql import functions as F

    row = box.select(boxes.scaled(F.col("b"), F.col("x"), F.col("y")).alias("s"), boxes.scaled(F.col("b"), F.col("x"), F.col("z")).alias("n")).first()
    assert tuple(row.s) == (0, 3, 1, 0) and row.n is None
    assert pixels.fitted(4000, 3000, 1000) == (1000, 750) and pixels.fitted(4000, 3000, 1001) == (int(4000 * (1001 / 4000)), 750) and pixels.fitted(5, 5, 0) == (5, 5) and pixels.fitted(10000, 1, 10) == (10, 1)
