"""What the operators share: words, stable reads of a costly frame, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Has Arrow batches hold 1,000 rows where the session keeps Spark's default of 10,000: rows are whole texts, and an executor holds several batches at once."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session is local,
    as in tests, a temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="atelier-")
        sc.setCheckpointDir(root)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Has a query's shuffle files deleted when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str, default: str) -> Iterator[None]:
    """Within, the session has this setting; afterwards that which it had, or ``default``."""
    before = spark.conf.get(key, default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cleaned(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, what a query has shuffled is deleted when it ends: for writes whose result is read from files only."""
    return setting(spark, CLEANUP, "true", "false")


#: Greatest shuffled partition that a join may hold as a hash table, once its size has been measured.
HASH_MAP = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def hashed_joins(spark: SparkSession, size: str = "64m") -> AbstractContextManager[None]:
    """Within, a join whose side turns out to have no shuffled partition over ``size`` is done by hash tables, so that the large side isn't sorted; others stay sort-merge joins."""
    return setting(spark, HASH_MAP, size, "0b")


def stored(df: DataFrame, label: str, by: Sequence[str] = (), **options: str) -> DataFrame:
    """Writes a frame to the shared folder as Parquet and reads it back: computed once, and safe when an executor is lost. by: last columns whose values get files of their own."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, label)
    with cleaned(spark):
        df.write.options(**{"compression": "zstd"} | options).parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing will read again."""
    for path in {f.rpartition("/")[0] for df in frames for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the map of ids that goes to all tasks (4 MB), and of one of its pieces, as Spark's bitmap functions cut them.
MAP_BITS, PIECE_BITS = 1 << 25, 1 << 15


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be among ``ids``, and those whose key is certainly not.

    ids: one column, the key. A bit for each id's hash is set in a map of ``MAP_BITS`` bits, whose size
    doesn't depend on the data and which goes to all tasks; so rows that no id concerns stay where they
    are, and only the others have to be joined with the ids. Null keys are certainly not among them.
    """
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = ids.select(spread(F.col(key)).alias("_h")).where(F.col(key).isNotNull())
    pieces = bits.groupBy(F.shiftright("_h", 15).alias("_piece")).agg(F.bitmap_construct_agg(F.col("_h").bitwiseAND(F.lit(PIECE_BITS - 1))).alias("_bits"))
    at = F.col("_place").bitwiseAND(F.lit(PIECE_BITS - 1))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    placed = df.select(F.struct("*").alias("_row"), F.when(F.col(key).isNotNull(), spread(F.col(key))).alias("_place"))
    marked = placed.join(F.broadcast(pieces), F.shiftright("_place", 15) == F.col("_piece"), "left").select("_row", hit.alias("_hit"))
    return marked.where("_hit").select("_row.*"), marked.where("not _hit").select("_row.*")


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns as one, ``_row``, beside those that an operator reads, so that no column of the documents clashes with its own."""
    return docs.select(F.struct("*").alias("_row"), *needed)


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return df.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def word_count(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_of(batch: pa.RecordBatch, size: int, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``size`` characters of text each, one row at least; bounds a worker's memory."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= size or i == len(lengths) - 1:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
