"""Artwork archives (ZIP containers) as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GLOB = "*.[pP][rR][oO][cC][rR][eE][aA][tT][eE]"
MEMBERS = "path string, ord int, name string, is_dir boolean, method int, size long, packed long, crc long, error string"


def artworks(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Archives of a folder: path, modificationTime, length, content. Names that begin with a dot or an underscore are hidden."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", GLOB)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)


def artwork_stream(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The same as a stream, whose checkpoint remembers what was done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", GLOB)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)


def walk_key(path: Column, root: Column) -> Column:
    """Sorts paths as a walk lists them: a folder's files by name, then its folders by name."""
    parts = F.split(F.substr(path, F.length(root) + 2), "/")
    return F.transform(parts, lambda p, i: F.struct((i < F.size(parts) - 1).alias("deeper"), p.alias("name")))


def _opened(content: bytes) -> tuple[zipfile.ZipFile | None, str | None]:
    if not content:
        return None, "empty file"
    try:
        return zipfile.ZipFile(io.BytesIO(content)), None
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        return None, f"not a ZIP archive: {e}"


def members(files: DataFrame) -> DataFrame:
    """Central directories: a row a member in archive order, or one with an error for a file that is no archive."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                z, error = _opened(content)
                infos = z.infolist() if z else []
                rows = [(path, i, m.filename, m.is_dir(), m.compress_type, m.file_size, m.compress_size, m.CRC, None) for i, m in enumerate(infos)]
                yield pd.DataFrame(rows if z else [(path, None, None, None, None, None, None, None, error)], columns=[c.split()[0] for c in MEMBERS.split(", ")])

    return files.select("path", "content").mapInPandas(listed, MEMBERS)


def contents(files: DataFrame, name_pattern: str) -> DataFrame:
    """Inflated members whose whole name matches: path, ord, name, data, error. Sizes and CRCs are checked; each member is a row of its own."""
    import re

    wanted = re.compile(name_pattern)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                z, _ = _opened(content)
                for i, m in enumerate(z.infolist() if z else []):
                    if wanted.fullmatch(m.filename) and not m.is_dir():
                        try:
                            row = (path, i, m.filename, z.read(m), None)
                        except Exception as e:  # a damaged member is a row, not the end of the job
                            row = (path, i, m.filename, None, f"{type(e).__name__}: {e}")
                        yield pd.DataFrame([row], columns=["path", "ord", "name", "data", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, ord int, name string, data binary, error string")


def first_of_name(rows: DataFrame) -> DataFrame:
    """Of members with one name in an archive the first; rows of ``members`` or ``contents``."""
    rest = [c for c in rows.columns if c not in ("path", "name")]
    return rows.groupBy("path", "name").agg(F.min_by(F.struct(*rest), "ord").alias("m")).select("path", "name", "m.*")


def ranged(rows: DataFrame, start: Column | int, size: Column | int) -> DataFrame:
    """``contents`` cut to ``size`` bytes from a 0-based start. The whole member was read and its CRC checked; a range beyond its end is an error."""
    at, n = (F.lit(v) if isinstance(v, int) else v for v in (start, size))
    short = F.col("data").isNotNull() & (F.octet_length("data") < at + n)
    cut = F.when(~short, F.substring("data", (at + 1).cast("int"), n.cast("int")))
    return rows.withColumn("error", F.when(short, "range beyond the member").otherwise(F.col("error"))).withColumn("data", cut)


def has_timelapse(member_rows: DataFrame, pattern: str) -> DataFrame:
    """Whether each archive has a member of that name: path, has_timelapse. Nothing is inflated for it."""
    return member_rows.groupBy("path").agg(F.coalesce(F.bool_or(F.col("name").rlike(pattern) & ~F.col("is_dir")), F.lit(False)).alias("has_timelapse"))
