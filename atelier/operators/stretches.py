"""Ordered groups of any size, cut into stretches of neighbouring rows; scans over them are stitched where stretches meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from atelier.session import shared_folder

#: Rows of a group that one task orders; larger groups are cut.
ROWS = 1 << 20


def all_equal(group: list[str], prefix: str = "_g_") -> Column:
    """Whether a row's group is that of a row whose columns have the prefix; nulls are equal."""
    out = F.lit(True)
    for g in group:
        out = out & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return out


class Stretches:
    """Rows with ``_stretch``: rows of one group and stretch are neighbours, and a group's stretches ascend in its order.

    Groups of up to ``rows`` rows are one stretch, number 0, and stay where they are. Larger ones are dealt
    by ranges of group and order and written to the shared folder, as range borders are sampled and a
    second reading could cut elsewhere. Neither those groups' list nor that of their stretches, which
    go to all tasks, has more than one row for each ``rows`` rows of the table and one a task.
    The order must be total within a group where results depend on it; its columns ascend, nulls first.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str], rows: int = ROWS) -> None:
        spark = df.sparkSession
        self.group, self.order, self.columns = group, order, df.columns
        shared_folder(spark)
        keys = [F.col(g).alias(f"_g_{g}") for g in group]
        large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*keys, "_n").checkpoint()
        total = large.agg(F.sum("_n")).first()[0]
        self.many = total is not None
        if not self.many:
            self.rows = df.withColumn("_stretch", F.lit(0).cast("long"))
            return
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows))
        marked = df.join(F.broadcast(large), all_equal(group), "left")
        dealt = marked.where(F.col("_n").isNotNull()).select(df.columns).repartitionByRange(tasks, *group, *order)
        dealt = dealt.withColumn("_stretch", (F.spark_partition_id() + 1).cast("long")).checkpoint()
        self.rows = marked.where(F.col("_n").isNull()).select(*df.columns, F.lit(0).cast("long").alias("_stretch")).unionByName(dealt)

    def inside(self) -> WindowSpec:
        return Window.partitionBy(*self.group, "_stretch").orderBy(*self.order)

    def _stitched(self, rows: DataFrame, of_stretch: Column, across: Callable[[Column, WindowSpec], Column]) -> DataFrame:
        """Adds ``_met``, what a stretch takes over from the others of its group; null for groups of one stretch."""
        if not self.many:
            return rows.withColumn("_met", F.lit(None))
        each = rows.where("_stretch > 0").groupBy(*self.group, "_stretch").agg(of_stretch.alias("_own"))
        met = across(F.col("_own"), Window.partitionBy(*self.group).orderBy("_stretch"))
        table = each.select(*[F.col(g).alias(f"_g_{g}") for g in self.group], F.col("_stretch").alias("_s"), met.alias("_met"))
        keys = [f"_g_{g}" for g in self.group]
        return rows.join(F.broadcast(table), (F.col("_stretch") == F.col("_s")) & all_equal(self.group), "left").drop("_s", *keys)

    def neighbour(self, rows: DataFrame, values: list[str], out: str, ahead: bool = False) -> DataFrame:
        """Adds the struct of values of the row before (or after) in the group; null for the first (or last)."""
        value = F.struct(*values)
        step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
        rows = rows.withColumn(out, step(value).over(self.inside()))
        rows = self._stitched(rows, edge(value, F.struct(*self.order)), lambda own, w: step(own).over(w))
        return rows.withColumn(out, F.coalesce(out, "_met") if self.many else F.col(out)).drop("_met")

    def before(self, rows: DataFrame, value: Column, out: str, combine: Callable[[Column], Column] = F.sum, joined: Callable[[Column, Column], Column] = lambda a, b: a + b, ties: bool = False) -> DataFrame:
        """Adds the aggregate (sum, or another that combines with itself) of ``value`` over the group's rows before each; null without one.

        With ``ties``, rows that have the same order key don't count for each other; the key must then be one number.
        """
        frame = self.inside()
        frame = frame.rangeBetween(Window.unboundedPreceding, -1) if ties else frame.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_value", value).withColumn(out, combine(F.col("_value")).over(frame))
        rows = self._stitched(rows, combine(F.col("_value")), lambda own, w: combine(own).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        both = F.coalesce(joined(F.col(out), F.col("_met")), F.col(out), F.col("_met")) if self.many else F.col(out)
        return rows.withColumn(out, both).drop("_met", "_value")
