"""Folders of artworks as a stream: each file once, whatever is interrupted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atelier.plans import timelapse
from atelier.sources import archive


def list_new(spark: SparkSession, folder: str, out: str, checkpoint: str, recursive: bool = False) -> None:
    """Appends the listing of archives that weren't listed before to ``out`` (Parquet), and returns when there are no more.

    The checkpoint is the set of what is done. A batch that is run again overwrites its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        timelapse.listing(archive.members(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = archive.artwork_stream(spark, folder, recursive)
    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
