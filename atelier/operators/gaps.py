"""Holes in integer sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.operators.stretches import ROWS, Stretches


def gap_ranges(df: DataFrame, group: list[str], number: str, rows: int = ROWS) -> DataFrame:
    """Missing ranges between the smallest and the largest number of each group: group, lo, hi.

    Repeats count once and null numbers are ignored. A hole is one row however wide it is, so a
    hostile number cannot blow up the result.
    """
    cut = Stretches(df.where(F.col(number).isNotNull()).select(*group, number).distinct(), group, [number], rows)
    before, own = F.col("_before")[number], F.col(number)
    holes = cut.neighbour(cut.rows, [number], "_before").where(own > before + 1)
    return holes.select(*group, (before + 1).alias("lo"), (own - 1).alias("hi"))


def range_text(lo: Column, hi: Column) -> Column:
    """``3`` or ``3-7``."""
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo, hi))


def ranges_text(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Ranges of each group as text such as ``1-3, 7, 9-10``, and their number."""
    one = range_text(F.col("lo"), F.col("hi"))
    return (
        ranges.groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("lo", one.alias("s")))).alias("_r"))
        .select(*group, F.size("_r").cast("long").alias("n_gaps"), F.array_join(F.col("_r.s"), ", ").alias("missing"))
    )
