"""Aggregations: clashes, best rows, cells, boxes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clashes(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has: key, n_rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def best(df: DataFrame, group: list[str], rank: list[Column], keep: list[str]) -> DataFrame:
    """Of each group the row with the greatest rank; what is kept of it comes from one row."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*keep), F.struct(*rank)).alias("_b")).select(*group, "_b.*")


def cell_mean(df: DataFrame, x: Column, y: Column, value: Column, size: tuple[int, int], cells: tuple[int, int]) -> DataFrame:
    """Integer mean of the values in each cell of a grid laid over ``size`` points: cx, cy, n, mean.

    Point p of s belongs to cell ((p + 1) * c - 1) div s of c, so cells differ by one point at most.
    """
    cell = lambda p, s, c: F.floor(((p + 1) * c - 1) / s).cast("long")
    at = df.select(cell(x, size[0], cells[0]).alias("cx"), cell(y, size[1], cells[1]).alias("cy"), value.cast("long").alias("_v"))
    sums = at.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("_sum"))
    return sums.select("cx", "cy", "n", F.expr("_sum div n").alias("mean"))


def bounding_box(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Half-open box around the points of each group: group, x0, y0, x1, y1."""
    return df.groupBy(*group).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))


def coverage(df: DataFrame, levels: list[str], hit: Column) -> DataFrame:
    """Valid and covered rows and their rate at every level of a rollup: levels, valid, covered, rate."""
    rolled = df.rollup(*levels).agg(F.count(F.lit(1)).alias("valid"), F.count_if(hit).alias("covered"))
    return rolled.withColumn("rate", F.round(F.col("covered") / F.col("valid"), 4))


def has_video(tracks: DataFrame, group: list[str]) -> DataFrame:
    """Whether a group's tracks hold video: group, has_video."""
    return tracks.groupBy(*group).agg(F.bool_or(F.col("handler") == "vide").alias("has_video"))
