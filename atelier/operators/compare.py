"""Operators that hold rows against other rows: first of the group, earlier output, overriding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def against_first(df: DataFrame, group: list[str], order: str, fields: list[str], out: str = "differs") -> DataFrame:
    """Adds the names of the fields in which a row differs from its group's first row, in the order given.

    The first rows are an aggregate with one row a group, joined back, so a large group is split.
    """
    first = df.groupBy(*group).agg(F.min_by(F.struct(*fields), F.col(order)).alias("_first"))
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_first.{f}")), F.lit(f)) for f in fields]))
    return df.join(first, group).withColumn(out, names).drop("_first")


def differ_text(fields: Column) -> Column:
    """``field "x" differs`` or ``fields "x", "y" differ``; null where there is none."""
    quoted = F.array_join(F.transform(fields, lambda f: F.concat(F.lit('"'), f, F.lit('"'))), ", ")
    return F.when(F.size(fields) == 1, F.concat(F.lit("field "), quoted, F.lit(" differs"))).when(
        F.size(fields) > 1, F.concat(F.lit("fields "), quoted, F.lit(" differ"))
    )


def differing_fields(rows: DataFrame, group: list[str], order: str, differs: str = "differs", out: str = "fields") -> DataFrame:
    """The distinct fields of each group's rows in the order in which they occur first: group, fields."""
    each = rows.select(*group, F.col(order).alias("_o"), F.posexplode(differs).alias("_pos", "_field"))
    first = each.groupBy(*group, "_field").agg(F.min(F.struct("_o", "_pos")).alias("_at"))
    return first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_at", "_field"))).alias("_f")).select(*group, F.col("_f._field").alias(out))


def presence(wanted: DataFrame, done: DataFrame, group: list[str], key: str) -> DataFrame:
    """Whether none, some or all of each group's keys are in ``done``: group, n_wanted, n_done, state."""
    marked = wanted.join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    counted = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_wanted"), F.count("_done").alias("n_done"))
    state = F.when(F.col("n_done") == 0, "none").when(F.col("n_done") == F.col("n_wanted"), "all").otherwise("some")
    return counted.withColumn("state", state)


def override(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key ``new`` doesn't have."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti").select(new.columns))


def missing_from(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't in ``done``."""
    return df.join(done.select(*key).distinct(), key, "left_anti").select(df.columns)
