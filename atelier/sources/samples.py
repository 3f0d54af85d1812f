"""Sample tables as rows: blocks of sizes and entries of runs, so that a track of any length is spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.operators.stretches import ROWS, Stretches

#: Sizes in a block, and blocks that a worker hands on at once.
BLOCK, AT_ONCE = 512, 64
TRACK = ["path", "name", "track"]


def _numbers(payload: bytes, at: int, count: int, fields: int) -> np.ndarray | None:
    """Rows of big-endian numbers of 4 bytes; None where the payload doesn't hold them all."""
    if len(payload) < at + 4 * fields * count:
        return None
    return np.frombuffer(payload, ">u4", count * fields, at).astype(np.int64).reshape(count, fields)


def size_tables(box_rows: DataFrame) -> DataFrame:
    """Heads of the size tables: path, name, track, n_samples, uniform (the size of all samples, or 0)."""
    from atelier.functions.binary import unsigned_be

    p = F.col("payload")
    return box_rows.where("type = 'stsz' AND track IS NOT NULL").select(*TRACK, unsigned_be(p, 8, 4).alias("n_samples"), unsigned_be(p, 4, 4).alias("uniform"))


def size_blocks(box_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sizes that a table lists: path, name, track, block (from 0), sizes. A table that its box doesn't hold in full has none, nor has one of a uniform size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch.column(3)[row].as_py() or b""
                uniform, n = (int.from_bytes(payload[k : k + 4], "big") for k in (4, 8))
                values = None if uniform or len(payload) < 12 else _numbers(payload, 12, n, 1)
                for lo in range(0, 0 if values is None else n, block * AT_ONCE):
                    flat = values[lo : lo + block * AT_ONCE, 0]
                    ends = np.append(np.arange(0, len(flat), block), len(flat)).astype(np.int32)
                    some = len(ends) - 1
                    key = [pa.repeat(batch.column(k)[row], some) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(some) + lo // block), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*TRACK, "block", "sizes"])

    rows = box_rows.where("type = 'stsz' AND track IS NOT NULL").select(*TRACK, "payload")
    return rows.mapInArrow(cut, "path string, name string, track int, block long, sizes array<long>")


def chunk_runs(box_rows: DataFrame) -> DataFrame:
    """Entries of the tables of samples a chunk: path, name, track, first_chunk, per_chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch.column(3)[row].as_py() or b""
                n = int.from_bytes(payload[4:8], "big")
                values = _numbers(payload, 8, n, 3)
                for lo in range(0, 0 if values is None else n, block_rows):
                    part = values[lo : lo + block_rows]
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(k)[row], len(part)) for k in range(3)), pa.array(part[:, 0]), pa.array(part[:, 1])], names=[*TRACK, "first_chunk", "per_chunk"])

    block_rows = BLOCK * AT_ONCE
    rows = box_rows.where("type = 'stsc' AND track IS NOT NULL").select(*TRACK, "payload")
    return rows.mapInArrow(cut, "path string, name string, track int, first_chunk long, per_chunk long")


def blocked(rows: DataFrame, key: list[str], position: str, value: str, block: int = BLOCK) -> DataFrame:
    """Rows with a position from 1 as blocks of values: key, block, sizes."""
    placed = rows.select(*key, F.floor((F.col(position) - 1) / block).cast("long").alias("block"), F.struct(F.col(position).alias("p"), F.col(value).cast("long").alias("v")).alias("r"))
    return placed.groupBy(*key, "block").agg(F.array_sort(F.collect_list("r")).alias("r")).select(*key, "block", F.col("r.v").alias("sizes"))


def chunks(runs: DataFrame, ends: DataFrame, key: list[str], rows: int = ROWS) -> DataFrame:
    """Chunks that runs of equal numbers of samples make: key, chunk, first_sample (from 1), n_samples.

    runs: key, first_chunk, per_chunk. ends: key, n_chunks. The samples before a run are summed over runs,
    and those before a chunk in its run follow from its place, so no task goes through a track's chunks.
    """
    cut = Stretches(runs, key, ["first_chunk"], rows)
    following = cut.neighbour(cut.rows, ["first_chunk"], "_next", ahead=True).join(ends, key)
    reach = following.withColumn("_stop", F.coalesce(F.col("_next.first_chunk") - 1, F.col("n_chunks")))
    held = F.greatest(F.col("_stop") - F.col("first_chunk") + 1, F.lit(0)) * F.col("per_chunk")
    placed = cut.before(reach, held, "_before").where(F.col("_stop") >= F.col("first_chunk"))
    each = placed.withColumn("chunk", F.explode(F.sequence("first_chunk", "_stop")))
    first = F.coalesce("_before", F.lit(0)) + (F.col("chunk") - F.col("first_chunk")) * F.col("per_chunk") + 1
    return each.select(*key, "chunk", first.alias("first_sample"), F.col("per_chunk").alias("n_samples"))


def chunk_bytes(chunk_rows: DataFrame, tables: DataFrame, blocks: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Bytes of every chunk: key, chunk, first_sample, n_samples, bytes.

    tables: key, n_samples, uniform; blocks as ``size_blocks`` has them. A chunk is split where blocks end, each
    piece meets its block and adds up its own sizes, and pieces are summed, so neither a track's sizes
    nor those of a chunk come together. Samples beyond the table count nothing.
    """
    known = chunk_rows.join(tables.select(*key, F.col("n_samples").alias("_all"), "uniform"), key)
    stop = F.least(F.col("first_sample") + F.col("n_samples") - 1, F.col("_all"))
    known = known.withColumn("_last", stop)
    uniform = F.greatest(F.col("_last") - F.col("first_sample") + 1, F.lit(0)) * F.col("uniform")
    same = known.where("uniform > 0").select(*key, "chunk", "first_sample", "n_samples", uniform.alias("bytes"))
    at = lambda s: F.floor((F.col(s) - 1) / block).cast("long")
    touched = F.when(F.col("_last") >= F.col("first_sample"), F.sequence(at("first_sample"), at("_last")))
    pieces = known.where("uniform = 0").withColumn("block", F.explode_outer(touched))
    lo = F.greatest(F.col("first_sample") - F.col("block") * block, F.lit(1)).cast("int")
    hi = F.least(F.col("_last") - F.col("block") * block, F.lit(block)).cast("int")
    own = F.aggregate(F.slice("sizes", lo, hi - lo + 1), F.lit(0).cast("long"), lambda a, v: a + v)
    met = pieces.join(blocks, [*key, "block"], "left").select(*key, "chunk", "first_sample", "n_samples", own.alias("_own"))
    listed = met.groupBy(*key, "chunk", "first_sample", "n_samples").agg(F.coalesce(F.sum("_own"), F.lit(0)).alias("bytes"))
    return same.unionByName(listed)
