"""Resumable runs: each batch's projects are written, packed with a record in a log, and only then retired."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atelier.plans import timelapse
from atelier.sources import archive

LOOSE, PACKED, LOG = "projects", "packed", "log"


class Log:
    """Records of what is packed, a file each, in the order of their numbers. A record is there in full or not at all, and is never changed."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.folder = spark, f"{out}/{LOG}"
        self.jvm = spark._jvm
        self.store = self._path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.store.exists(self._path(path))

    def remove(self, path: str) -> None:
        """Nothing happens where it is gone already."""
        self.store.delete(self._path(path), True)

    def numbers(self) -> list[int]:
        if not self.exists(self.folder):
            return []
        names = (s.getPath().getName() for s in self.store.listStatus(self._path(self.folder)))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, number: int, record: dict) -> bool:
        """Adds a record, and tells whether it wasn't there. It is written beside its place and moved there; whoever comes later changes nothing."""
        place = self._path(f"{self.folder}/{number:020d}.json")
        if self.store.exists(place):
            return False
        part = self._path(f"{self.folder}/{number:020d}.partial")
        stream = self.store.create(part, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        return self.store.rename(part, place)


def _rows(batch: DataFrame) -> DataFrame:
    """What a slimmed project keeps of each archive: path, modificationTime, ord, name, data, error."""
    held = archive.contents(batch, r"(?s).*").drop("error")
    listed = archive.members(batch).select("path", "ord", "name", "is_dir", "error")
    kept = timelapse.slim_members(listed).join(held.select("path", "ord", "data"), ["path", "ord"], "left")
    times = batch.select("path", "modificationTime")
    return kept.join(times, "path").select("path", "modificationTime", "ord", "name", "data", "error")


def pack(spark: SparkSession, out: str, number: int, between: Callable[[], None] | None = None) -> None:
    """Packs a batch's loose projects: copied, then recorded, then retired. Any step that was done before an interruption is found done.

    Until the record is there the loose rows are the only ones that count; from then on they are extra.
    ``between`` runs between the record and the end of the loose rows.
    """
    log, loose = Log(spark, out), f"{out}/{LOOSE}/batch={number}"
    if not log.exists(loose):
        return
    if number not in log.numbers():
        spark.read.parquet(loose).write.mode("overwrite").parquet(f"{out}/{PACKED}/part={number}")
        log.commit(number, {"part": f"part={number}"})
    if between:
        between()
    log.remove(loose)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The packed set as it is: of each archive the rows of its last version; batches that are still loose win over packed ones.

    Parts without a record don't count, nor do loose batches that are recorded already.
    """
    log = Log(spark, out)
    done = log.numbers()
    parts = [(f"{out}/{PACKED}/part={n}", n) for n in done]
    if log.exists(f"{out}/{LOOSE}"):
        loose = (s.getPath().getName() for s in log.store.listStatus(log._path(f"{out}/{LOOSE}")))
        parts += [(f"{out}/{LOOSE}/batch={n}", n) for n in sorted(int(x[6:]) for x in loose if x.startswith("batch=")) if n not in done and log.exists(f"{out}/{LOOSE}/batch={n}/_SUCCESS")]
    schema = "path string, modificationTime timestamp, ord int, name string, data binary, error string, version long"
    rows = spark.createDataFrame([], schema)
    for path, n in parts:
        rows = rows.unionByName(spark.read.parquet(path).withColumn("version", F.lit(n).cast("long")))
    last = F.max("version").over(Window.partitionBy("path"))
    return rows.withColumn("_last", last).where("version = _last").drop("_last")


def convert_new(spark: SparkSession, folder: str, out: str, checkpoint: str, recursive: bool = False, between: Callable[[], None] | None = None) -> None:
    """Slims archives that weren't before into the packed set of ``out``, and returns when there are no more.

    A batch that an interruption left half done is run again and changes nothing that is there: its
    loose rows are overwritten, its record is kept. An archive that was packed by an earlier batch and has changed
    under another name of its own is a version of its own. Batches that are recorded but still have loose
    rows are retired first.
    """
    log = Log(spark, out)
    for n in log.numbers():
        log.remove(f"{out}/{LOOSE}/batch={n}")

    def write(batch: DataFrame, number: int) -> None:
        if number not in Log(spark, out).numbers():
            _rows(batch).write.mode("overwrite").parquet(f"{out}/{LOOSE}/batch={number}")
        pack(spark, out, number, between)

    files = archive.artwork_stream(spark, folder, recursive)
    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
