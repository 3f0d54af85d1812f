"""Archives read where they are: directories from a file's end, members by ranges of bytes with their checksums."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.functions.checksums import moved
from atelier.sources.listing import opened

#: Bytes of a member that one task reads at a time, and that are held at once.
PIECE, HELD = 64 << 20, 1 << 20
STORED, DEFLATED = 0, 8
DIRECTORY = "path string, ord int, name string, is_dir boolean, method int, size long, packed long, crc long, header long, read_bytes long, error string"


class Counted(io.RawIOBase):
    """A file that counts what is read of it."""

    def __init__(self, path: str) -> None:
        store, at = opened(path)
        self.file, self.count = store.open_input_file(at), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer: memoryview) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        self.count += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def directories(files: DataFrame) -> DataFrame:
    """Members of archives in archive order, or a row with an error: path, ord, name, is_dir, method, size, packed, crc, header (where the member begins), read_bytes, error.

    files: path. Only the end of each file is read (``read_bytes``, of the whole archive), however large
    its members are.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DIRECTORY.split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                try:
                    with Counted(path) as file, zipfile.ZipFile(file) as z:
                        infos, count = z.infolist(), file.count
                    rows = [(path, i, m.filename, m.is_dir(), m.compress_type, m.file_size, m.compress_size, m.CRC, m.header_offset, count, None) for i, m in enumerate(infos)]
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows = [(path, *[None] * (len(columns) - 2), f"not a ZIP archive: {e}")]
                yield pd.DataFrame(rows, columns=columns).astype({"ord": "Int32", "method": "Int32", "size": "Int64", "packed": "Int64", "crc": "Int64", "header": "Int64", "read_bytes": "Int64"})

    return files.select("path").mapInPandas(read, DIRECTORY)


def _begin(file: Counted, header: int) -> int:
    """Where a member's data begins."""
    file.seek(header)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise ValueError("bad member header")
    return header + 30 + sum(struct.unpack("<HH", head[26:30]))


def _chunks(file: Counted, start: int, size: int) -> Iterator[bytes]:
    file.seek(start)
    while size:
        data = file.read(min(size, HELD))
        if not data:
            raise ValueError("member ends early")
        size -= len(data)
        yield data


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    engine = zlib.decompressobj(-15)
    for data in chunks:
        while data:
            yield engine.decompress(data, HELD)
            data = engine.unconsumed_tail
    yield engine.flush()


def _piece(row: object, piece: int, lo: int, hi: int) -> tuple[int, int, bytes]:
    """Checksum of a piece moved to its place in the member, its bytes, and those of them between lo and hi."""
    with Counted(row.path) as file:
        begin = _begin(file, row.header)
        if row.method == STORED:
            at, length = row.piece * piece, min(piece, row.size - row.piece * piece)
            chunks = _chunks(file, begin + at, length)
        elif row.method == DEFLATED:
            at, chunks = 0, _inflated(_chunks(file, begin, row.packed))
        else:
            raise ValueError(f"compression method {row.method}")
        crc, kept, place = 0, [], at
        for data in chunks:
            crc = zlib.crc32(data, crc)
            kept.append(data[max(lo - place, 0) : max(hi - place, 0)])
            place += len(data)
            if place > row.size:
                raise ValueError("member is longer than its directory says")
        return moved(crc, row.size - place), place - at, b"".join(kept)


def members(directory: DataFrame, start: int, size: int, piece: int = PIECE) -> DataFrame:
    """``size`` bytes from a 0-based start of every member that a directory lists: path, ord, name, data, error.

    A stored member is cut into pieces of ``piece`` bytes, which are read by as many tasks; each gives the
    checksum of all its bytes, moved to its place, and those of its bytes that are wanted. A deflated
    one is inflated by one task, ``HELD`` bytes at a time. A member whose checksum or size isn't what the
    directory says is an error, wherever the damage is, and so is a range beyond its end.
    """
    count = F.when(F.col("method") == STORED, F.greatest(F.ceil(F.col("size") / piece), F.lit(1))).otherwise(1).cast("int")
    rows = directory.where("error IS NULL AND NOT is_dir").select("path", "ord", "name", "method", "size", "packed", "crc", "header", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    tasks = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                try:
                    crc, n, data, error = *_piece(row, piece, start, start + size), None
                except (ValueError, OSError, zlib.error) as e:
                    crc, n, data, error = 0, 0, b"", str(e)
                yield pd.DataFrame([(row.path, row.ord, row.name, row.size, row.crc, row.piece, crc, n, data, error)], columns=["path", "ord", "name", "size", "crc", "piece", "own", "n", "data", "error"])

    pieces = rows.repartition(tasks, "path", "ord", "piece").mapInPandas(read, "path string, ord int, name string, size long, crc long, piece int, own long, n long, data binary, error string")
    parts = F.array_sort(F.collect_list(F.when(F.octet_length("data") > 0, F.struct("piece", "data"))))
    whole = pieces.groupBy("path", "ord", "name", "size", "crc").agg(F.bit_xor("own").alias("own"), F.sum("n").alias("n"), parts.alias("parts"), F.min("error").alias("failed"))
    data = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    error = F.coalesce(
        "failed", F.when(F.col("n") != F.col("size"), "member isn't as long as its directory says").when(F.col("own") != F.col("crc"), "bad checksum").when(F.col("size") < start + size, "range beyond the member")
    )
    return whole.select("path", "ord", "name", F.when(error.isNull(), data).alias("data"), error.alias("error"))
