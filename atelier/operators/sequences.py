"""Operators on ordered rows: runs, prefix sums, expansions, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.operators.stretches import ROWS, Stretches, all_equal
from atelier.session import shared_folder

def _begins(df: DataFrame, group: list[str], order: list[str], same: list[str], rows: int) -> tuple[Stretches, DataFrame]:
    """Rows with ``_new``: whether a row differs from the one before it in ``same``, or is its group's first."""
    cut = Stretches(df, group, order, rows)
    placed = cut.neighbour(cut.rows, same, "_before")
    return cut, placed.withColumn("_new", F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*same))).drop("_before")


def runs(df: DataFrame, group: list[str], order: list[str], same: list[str], total: str | None = None, rows: int = ROWS) -> DataFrame:
    """Runs of neighbouring rows that agree in ``same``: group, run (from 1), same, n_rows, first and last order key, and the sum of ``total``.

    The order must be total within a group. A run begins where a row differs from the one before it; it
    may reach over many stretches of a large group, in which its rows are summed before they are shuffled.
    """
    cut, placed = _begins(df, group, order, same, rows)
    begun = F.col("_new").cast("long")
    numbered = cut.before(placed, begun, "_runs").withColumn("run", F.coalesce("_runs", F.lit(0)) + begun)
    key = F.struct(*order)
    sums = [F.sum(total).alias(total)] if total else []
    ends = [F.min(key)[order[0]].alias(f"first_{order[0]}"), F.max(key)[order[0]].alias(f"last_{order[0]}")]
    return numbered.groupBy(*group, "run", *same).agg(F.count(F.lit(1)).alias("n_rows"), *ends, *sums)


def changes(df: DataFrame, group: list[str], order: list[str], same: list[str], rows: int = ROWS) -> DataFrame:
    """Rows that differ from the one before them in ``same``, first rows included: what a table of runs by start keeps."""
    return _begins(df, group, order, same, rows)[1].where("_new").select(df.columns)


def prefix_sum(df: DataFrame, group: list[str], order: str, value: str, out: str = "start", width: int | None = None, rows: int = ROWS) -> DataFrame:
    """Sum of ``value`` over the rows of the group before each row, in order of an integer key.

    Equal keys share a start. A group of more than ``rows`` rows is cut by rows, whatever its keys; with
    ``width``, for dense keys, every group is cut into stretches of so many keys, which takes no count of rows.
    """
    if width is None:
        cut = Stretches(df, group, [order], rows)
        summed = cut.before(cut.rows, F.col(value), out, ties=True)
        return summed.select(*[c for c in df.columns if c != out], F.coalesce(out, F.lit(0)).alias(out))
    cut = df.withColumn("_cut", F.floor(F.col(order) / width).cast("long"))
    sums = cut.groupBy(*group, "_cut").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cut").alias("_c"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_cut").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = (F.col("_cut") == F.col("_c")) & all_equal(group)
    return summed.join(offsets, on).select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(out))


def expand_runs(df: DataFrame, group: list[str], first: str, end: Column | str, out: str = "at", width: int | None = None, rows: int = ROWS) -> DataFrame:
    """Each row repeated for every number from ``first`` to the row before the next row's ``first``; the last row's run ends at ``end``.

    Of rows with the same ``first`` only the last one's run has numbers. A group of more than ``rows`` rows is
    cut by rows, so sparse and dense groups of any size are spread alike; with ``width``, for dense
    keys, every group is cut into stretches of so many numbers, which takes no count of rows.
    """
    if width is None:
        cut = Stretches(df, group, [first], rows)
        placed = cut.neighbour(cut.rows, [first], "_ahead", ahead=True).withColumn("_next", F.col("_ahead")[first])
    else:
        dense = df.withColumn("_cut", F.floor(F.col(first) / width).cast("long"))
        least = dense.groupBy(*group, "_cut").agg(F.min(first).alias("_least"))
        after = F.lead("_least").over(Window.partitionBy(*group).orderBy("_cut"))
        following = least.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_cut").alias("_c"), after.alias("_after"))
        inside = F.lead(first).over(Window.partitionBy(*group, "_cut").orderBy(first))
        placed = dense.withColumn("_inside", inside).join(following, (F.col("_cut") == F.col("_c")) & all_equal(group)).withColumn("_next", F.coalesce("_inside", "_after"))
    stop = F.coalesce(F.col("_next") - 1, F.col(end) if isinstance(end, str) else end)
    spread = placed.withColumn("_stop", stop).where(F.col("_stop") >= F.col(first))
    return spread.select(*df.columns, F.explode(F.sequence(F.col(first), F.col("_stop"))).alias(out))


#: Rows that are folded in one list.
FOLDED = 1 << 16


def fold(
    df: DataFrame, group: list[str], order: str, value: str, start: Column, step: Callable[[Column, Column], Column], states: int, out: str = "folded", width: int | None = None, rows: int = FOLDED
) -> DataFrame:
    """Fold of each group's values in order, for steps that lead from one of the states 0 to ``states`` - 1 to another.

    A group of up to ``rows`` rows is folded from ``start`` in one go. Such a fold can be cut: a larger group is
    folded in stretches of about so many rows (or, with ``width``, every group in blocks of so many numbers of the
    integer order key), the first from ``start`` and each other from every state at once, which gives a
    table from the state before to that after it; the tables are then followed in order. So no task holds
    more of a group than a stretch, and one row a stretch. Equal keys are taken in the order of values.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    run = lambda state: F.aggregate("_rows", state.cast("long"), lambda acc, r: step(acc, r["v"]).cast("long"))
    if width is None:
        cut = Stretches(df, group, [order], rows)
        if not cut.many:
            return df.groupBy(*group).agg(sorted_.alias("_rows")).select(*group, run(start).alias(out))
        pieces = cut.rows.withColumnRenamed("_stretch", "_block")
    else:
        pieces = df.withColumn("_block", F.floor(F.col(order) / width).cast("long"))
    blocks = pieces.groupBy(*group, "_block").agg(sorted_.alias("_rows"))
    begins = F.row_number().over(Window.partitionBy(*group).orderBy("_block")) == 1
    table = F.when(begins, F.array(run(start))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(states - 1)), run))
    tables = blocks.select(*group, "_block", table.alias("_table")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_block", "_table"))).alias("_t"))
    followed = F.aggregate("_t", F.lit(0).cast("long"), lambda state, t: F.get(t["_table"], state.cast("int")))
    return tables.select(*group, followed.alias(out))


def numbered(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Adds the number, from 1, of each row in a total order over all rows.

    Rows are dealt to tasks by ranges of the order, sorted there and written to the shared folder with
    their place in the task, as the ranges' borders are sampled and a second reading could draw others.
    A row's number is its place and the rows of the ranges before. What meets in one task is a count a range.
    """
    spark = df.sparkSession
    shared_folder(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    placed = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_range", (before - F.col("_first") + 1).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_range").select(*df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(out))


def not_increasing(df: DataFrame, group: list[str], order: list[str], value: str, strict: bool = True, rows: int = ROWS) -> DataFrame:
    """Rows whose value isn't above that of the row before (or, if not strict, is below it)."""
    cut = Stretches(df, group, order, rows)
    before = F.col("_before")[value]
    kept = F.col(value) <= before if strict else F.col(value) < before
    return cut.neighbour(cut.rows, [value], "_before").where(kept).select(df.columns)
