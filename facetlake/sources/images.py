"""Image folders as tables of paths and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that are read, and folders that are passed over.
EXTENSIONS = ["jpg", "jpeg", "png", "heic", "heif", "bmp", "webp"]
SKIPPED = ["output", "cache"]


def supported(name: Column, extensions: list[str] | None = None) -> Column:
    """Not hidden, and one of the extensions in any case."""
    return ~name.startswith(".") & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(extensions or EXTENSIONS)


def scan_images(spark: SparkSession, root: str, extensions: list[str] | None = None, skipped: list[str] | None = None) -> DataFrame:
    """(path, length, modified, fingerprint), sorted by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    inner = F.substr(F.col("path"), F.locate(base, F.col("path")) + F.lit(len(base) + 1))
    parts = F.split(inner, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(folders, lambda f: f.startswith(".") | f.isin(skipped or SKIPPED))
    rows = files.where(~bad & supported(F.element_at(parts, -1), extensions))
    stamp = F.concat_ws(":", F.col("length").cast("string"), F.floor(F.unix_timestamp("modificationTime")).cast("string"))
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), stamp.alias("fingerprint")).orderBy("path")


def timestamps(photos: DataFrame, exif: list[str], modified: str) -> Column:
    """The first EXIF date that parses, else the file's time."""
    formats = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for c in exif for f in formats], F.col(modified))
