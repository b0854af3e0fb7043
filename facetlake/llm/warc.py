"""WARC archives with resolved revisits: deduplicate, write, and read back.

Writing shuffles headers (id, digest, length) by payload digest and joins the
pages' headers to the original of their digest: one response record holds the payload,
the others refer to it in revisit records with headers of their own. Payloads
of pages without a copy never leave the scan, and of copies only the originals'
move. A sink for Arrow batches makes the files: each record is a gzip member, as readers of
archives expect that look up single records, and a file starts with a record about itself. Files are
bounded by bytes: records are written by size, fewer to a file the larger they are.

Reading takes a file member by member, parses by content lengths, and joins revisit records to
the responses that they refer to, by record and digest.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .filters import flagged
from .storage import stored

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
END = "\r\n\r\n"
DATE = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _salt(of: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(salts)).cast("int")


def _salted(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """(_id, _url, _payload, digest, bytes, refers_to): refers_to is null for responses, _payload for revisits.

    Payloads count as equal by SHA-1 and length, from ``min_bytes`` on; the largest
    id of equal ones is the original, and rows that repeat its id are responses as
    well. A null id is the smallest. The digest may be on a third of all pages, so
    it is joined in ``salts`` parts; only counts and maxima meet before that.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")).select(
        "*", F.sha1(F.col("_payload").cast("binary")).alias("digest"), F.octet_length("_payload").cast("long").alias("bytes")
    )
    rows = rows.withColumn("_key", F.when(F.col("bytes") >= min_bytes, F.xxhash64("digest", "bytes")))
    headers = rows.where(F.col("_key").isNotNull()).groupBy("digest", "bytes", "_key").agg(F.max("_id").alias("original"), F.count("*").alias("n"))
    originals = stored(headers.where("n > 1").withColumn("_own", F.xxhash64("_key", "original")).drop("n"), "originals")
    marked = flagged(rows, F.col("_key"), originals, "_key", "shared")
    # Of pages with copies only the payload of those goes on that may be an original.
    shared = flagged(marked.where("shared"), F.xxhash64("_key", "_id"), originals, "_own", "first")
    moved = shared.withColumn("_payload", F.when(F.col("first"), F.col("_payload"))).withColumn("salt", _salt(F.struct("_id", "_url"), salts))
    parts = _salted(originals.select("digest", "bytes", "original", F.lit(True).alias("known")), salts)
    joined = moved.join(parts.hint("merge"), ["digest", "bytes", "salt"], "left")
    copy = F.col("known").isNotNull() & ~F.col("original").eqNullSafe(F.col("_id"))
    columns = ["_id", "_url", "_payload", "digest", "bytes", "refers_to"]
    copies = joined.withColumn("refers_to", F.when(copy, F.col("original"))).withColumn("_payload", F.when(~copy, F.col("_payload")))
    alone = marked.where("not shared").withColumn("refers_to", F.lit(None).cast(pages.schema[id_col].dataType))
    return copies.select(*columns).unionByName(alone.select(*columns))


#: Bytes that the records of a file may hold, one record larger than that excepted, and the sizes of block that have files of their own.
FILE_BYTES = 256 << 20
SIZES = [1 << 16, 1 << 20, 1 << 24]


def write_warc(resolved: DataFrame, path: str, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files under ``path``, one record and one gzip member for each row of ``resolve``.

    Each file starts with a ``warcinfo`` record. ``date`` is the moment of writing where it is not given. A record's
    name holds its page's id and digest. Existing files are an error. All is written in one pass over ``resolved``.
    """
    uri = F.coalesce(F.regexp_replace(F.col("_url"), r"[\x00-\x20]", "%20"), F.lit("about:blank"))
    record_id = lambda c: _lines(f"<{ID_PREFIX}", F.coalesce(c.cast("string"), F.lit("")), ":", F.col("digest"), ">")
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("bytes").cast("string"), END)
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    moment = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), DATE)
    header = _lines(
        f"{VERSION}\r\nWARC-Type: ",
        F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: ",
        record_id(F.col("_id")),
        "\r\nWARC-Date: ",
        moment,
        "\r\nWARC-Target-URI: ",
        uri,
        "\r\nWARC-Payload-Digest: sha1:",
        F.col("digest"),
        F.when(revisit, _lines(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: ", record_id(F.col("refers_to")))).otherwise(""),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ",
        F.octet_length(block).cast("string"),
        END,
    )
    spark = resolved.sparkSession
    spark.dataSource.register(WarcSink)
    rows = resolved.select(header.cast("binary").alias("header"), block.cast("binary").alias("block"))
    rows.write.format(WarcSink.name()).option("file_bytes", file_bytes).mode("append").save(path)


class WarcSink(DataSource):
    """Writes rows (header, block) as gzip members: Spark's text writer would compress a whole file as one."""

    @classmethod
    def name(cls) -> str:
        return "facetlake_warc"

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options["file_bytes"]))


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own; those of the attempts that count are moved into place at the end."""

    def __init__(self, path: str, file_bytes: int) -> None:
        self.path, self.file_bytes, self.job = path.rstrip("/"), file_bytes, uuid.uuid4().hex
        fs, root = self._open()
        if fs.get_file_info(root).type != FileType.NotFound and fs.get_file_info(FileSelector(root)):
            raise ValueError(f"{path} exists and is not empty")

    def _open(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def _pending(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = self._open()
        task = uuid.uuid4().hex
        folder, files, made = f"{self._pending(root)}/{task}", {}, 0
        try:
            for batch in iterator:
                for header, block in zip(batch.column("header"), batch.column("block"), strict=True):
                    header, block = header.as_py(), block.as_py()
                    n = len(header) + len(block) + len(END)
                    size = bisect.bisect_left(SIZES, len(block))
                    most = max(1, self.file_bytes // (SIZES[size] + 2048)) if size < len(SIZES) else self.file_bytes
                    out, records, held = files.pop(size, (None, 0, 0))
                    if out is not None and (records >= most or held + n > self.file_bytes):
                        out.close()
                        out = None
                    if out is None:
                        if not made:
                            fs.create_dir(folder, recursive=True)
                        name, records, held = f"{task}-{made:05d}.warc.gz", 0, 0
                        out, made = fs.open_output_stream(f"{folder}/{name}", compression=None), made + 1
                        out.write(member(*information(name)))
                    out.write(member(header, block))
                    files[size] = (out, records + 1, held + n)
        finally:
            for out, _, _ in files.values():
                out.close()
        return Written(task if made else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.folder is not None:
                fs.move(f"{self._pending(root)}/{m.folder}", f"{root}/{m.folder}")
        self._swept(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._swept(*self._open())

    def _swept(self, fs: FileSystem, root: str) -> None:
        if fs.get_file_info(self._pending(root)).type == FileType.Directory:
            fs.delete_dir(self._pending(root))


def information(name: str) -> tuple[bytes, bytes]:
    """Header and block of the ``warcinfo`` record of a file."""
    block = b"software: facetlake\r\nformat: WARC File Format 1.1\r\n"
    lines = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"]
    lines += [f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode(), block


def member(header: bytes, block: bytes) -> bytes:
    """One record as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([z.compress(header), z.compress(block), z.compress(END.encode()), z.flush()])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive's bytes."""
    place = 0
    while place < len(data):
        stop = data.index(b"\r\n\r\n", place)
        first, *lines = data[place:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {place}: {first[:40]!r}")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = stop + 4
        place = begin + int(headers["content-length"])
        yield headers, data[begin:place]
        place += 4


def members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The members of a gzip file one by one, read in steps; other bytes are one member as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    place = 0
    while place < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if place >= len(data):
                raise ValueError("a gzip member ends before its end")
            part = data[place : place + step]
            out.append(z.decompress(part))
            place += len(part)
        place -= len(z.unused_data)
        yield b"".join(out)


def _unzipped(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    return b"".join(members(data))


def _name(value: str | None) -> tuple[str | None, str | None]:
    """Id and digest in a record's name."""
    if value is None:
        return None, None
    page, _, digest = value.strip("<>").removeprefix(ID_PREFIX).rpartition(":")
    return page, digest


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, digest, url, payload) of all records of pages under ``path``.

    Ids are those that ``write_warc`` gave, as strings; the digest is the one in the
    header. The payload is what follows the HTTP header, in bytes; a revisit record
    has none (null).
    """
    names = ["record_id", "record_type", "refers_to", "digest", "url", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in (r for m in members(content.as_py()) for r in parse(m)):
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    body = block.partition(b"\r\n\r\n")[2] if kind != "revisit" else None
                    page, digest = _name(h["warc-record-id"])
                    rows.append((page, kind, _name(h.get("warc-refers-to"))[0], digest, h.get("warc-target-uri"), body))
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.string()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    schema = "record_id string, record_type string, refers_to string, digest string, url string, payload binary"
    return files.select("content").mapInArrow(run, schema)


def archive_report(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 1000, salts: int = 16
) -> DataFrame:
    """Writes the archives to ``path``, reads them back, and tells what each record holds.

    Returns (id_col, payload_bytes, payload_digest, record_type, refers_to), the
    bytes and the digest of the full payload: for a revisit record those of the
    response that it refers to, found by id and digest. Null payloads are empty;
    empty and short payloads are always responses. Rows that repeat the original's
    id are responses too; one id with several payloads is several records. Where no copy of a payload has an id, all are responses.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    write_warc(resolve(pages, id_col, payload_col, url_col, min_bytes, salts), path)
    kind = pages.schema[id_col].dataType
    typed = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    records = read_warc(spark, path).select(
        "record_id", "record_type", "refers_to", "digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    records = stored(records, "records")
    responses, revisits = (records.where(F.col("record_type") == t) for t in ("response", "revisit"))
    # Only responses that a revisit names are joined; they are few rows for each, so they go in ``salts`` parts.
    named = revisits.select("refers_to", "digest").distinct()
    there = responses.select(F.col("record_id").alias("refers_to"), "digest", "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "digest"])
    parts = _salted(named.hint("merge").join(there, ["refers_to", "digest"]), salts)
    resolved = revisits.drop("payload_bytes", "payload_digest").withColumn("salt", _salt(F.col("record_id"), salts)).join(parts.hint("merge"), ["refers_to", "digest", "salt"], "left")
    return responses.unionByName(resolved.select(*records.columns)).select(
        typed("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", typed("refers_to").alias("refers_to")
    )
