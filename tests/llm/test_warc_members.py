"""Archives as other readers see them: one gzip member for each record, and a record about the file first."""

import email
import gzip
import random
import zlib

import pyarrow as pa
import pytest

from facetlake.llm.warc import WarcWriter, members, resolve, write_warc


def plain_records(data):
    """(offset, headers, block) of each member, which has to be one whole record; shares nothing with the library's reader."""
    found, place = [], 0
    while place < len(data):
        z = zlib.decompressobj(16 + zlib.MAX_WBITS)
        raw = z.decompress(data[place:]) + z.flush()
        assert z.eof
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        assert version == b"WARC/1.1"
        headers = email.message_from_bytes(lines)
        n = int(headers["Content-Length"])
        assert rest[n:] == b"\r\n\r\n"
        found.append((place, headers, rest[:n]))
        place = len(data) - len(z.unused_data)
    return found


def test_each_record_is_a_member_of_its_own(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", "short", "é\r\n\r\nWARC/1.1\r\n" * 300, "q" * 5000, "q" * 5000, "w" * 70_000] + ["".join(rnd.choices("abc \n", k=2000)) for _ in range(60)]
    df = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(3)
    write_warc(resolve(df), f"file://{tmp_path}/w", date="2024-05-06T07:08:09Z", file_bytes=1 << 20)
    assert not list((tmp_path / "w").glob("_*"))
    seen = {}
    for f in (tmp_path / "w").rglob("*.warc.gz"):
        data = f.read_bytes()
        first, *records = plain_records(data)
        assert first[1]["WARC-Type"] == "warcinfo" and first[1]["WARC-Filename"] == f.name and b"WARC File Format 1.1" in first[2]
        assert records
        assert gzip.decompress(data) == b"".join(members(data))
        for offset, h, block in records:
            # A record can be read from its offset alone.
            assert zlib.decompressobj(31).decompress(data[offset:]).endswith(block + b"\r\n\r\n")
            seen[int(h["WARC-Record-ID"].split(":")[2])] = (h["WARC-Type"], block.partition(b"\r\n\r\n")[2], h["WARC-Date"], h["WARC-Refers-To"])
    assert {i: v[:2] for i, v in seen.items()} == {i: ("revisit", b"") if i == 4 else ("response", (t or "").encode()) for i, t in enumerate(texts)}
    assert seen[4][3].split(":")[2] == "5" and {v[2] for v in seen.values()} == {"2024-05-06T07:08:09Z"}


def test_members_of_any_length_and_broken_ones():
    data = [b"", b"a", bytes(range(256)) * 500]
    packed = b"".join(gzip.compress(d) for d in data)
    for step in (1, 7, 1 << 14, 1 << 20):
        assert list(members(packed, step)) == data
    assert list(members(b"plain")) == [b"plain"] and list(members(b"")) == [b""]
    with pytest.raises(ValueError, match="before its end"):
        list(members(packed[:-3]))


def test_only_attempts_that_count_are_there(tmp_path):
    rows = pa.record_batch({"header": [b"h"], "block": [b"b"]})

    def lost():
        yield rows
        raise RuntimeError("lost")

    writer = WarcWriter(f"file://{tmp_path}/w", 1 << 20)
    with pytest.raises(RuntimeError):
        writer.write(lost())
    again, none = writer.write(iter([rows])), writer.write(iter([]))
    assert not list((tmp_path / "w").glob("*.gz"))
    writer.commit([again, none, None])
    assert len(list((tmp_path / "w").rglob("*.gz"))) == 1 and not list((tmp_path / "w").glob("_*"))
    other = WarcWriter(f"file://{tmp_path}/v", 1 << 20)
    other.write(iter([rows]))
    other.abort([])
    assert not list((tmp_path / "v").rglob("*.gz"))
    with pytest.raises(ValueError, match="exists"):
        WarcWriter(f"file://{tmp_path}/w", 1 << 20)
