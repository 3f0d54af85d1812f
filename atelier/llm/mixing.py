"""Mixing sources to target weights by nested thresholds on hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import packed, stored, unpacked, word_count

#: Hashes have 60 bits, of which each level of the histogram looks at 12 more.
HASH_BITS, LEVEL_BITS = 60, 12


def unit_hash(doc_id: Column, seed: str = "") -> Column:
    """60 bits of an MD5 of the document's id; the order in which a source's documents are taken."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target size of every source: source, source_size, target.

    sizes: source and source_size, one row each. Sources in order of code points, null last, have the
    weights in turn and share ``share`` times all sizes; none gets over ``most`` times its own size, and
    what it can't take goes to the others by weight until none is above. That water level is found
    in one pass over the sources in order of size a weight, without iteration. This table has one
    row a source, which is all that the windows without a key see.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(w) for w in weights])
    numbered = sizes.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    caps = numbered.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = caps.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)  # levels only sink from the first that fits
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(water, F.lit(float("inf"))))
    return leveled.select("source", "source_size", target.alias("target"))


def _nearest(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket in which each source's budget ends: keys, budget left before it, and its number."""
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return histogram.withColumn("before", before).where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("n")))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: passes (whole copies of all its documents) and limit (hashes below it are taken once more).

    sized: source, size, h. Sizes are summed by source and the top bits of the hash; the bucket in
    which the budget ends is split by the next bits, and so on down to one hash value, so each level
    reads the rows of one bucket a source and shuffles at most 4,096 sums a source and task. The
    limit is set before or after that last value, whichever is nearer to the budget.
    """
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    open_ = stored(
        goals.select("source", passes.cast("long").alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix")),
        "budgets",
    )
    every = open_.select("source", "passes")
    for used in range(0, HASH_BITS, LEVEL_BITS):
        left = HASH_BITS - used - LEVEL_BITS
        key = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("h", left + LEVEL_BITS) == F.col("prefix"))
        sums = (
            sized.where("size > 0")
            .join(open_.withColumnRenamed("source", "_source"), key)
            .groupBy("source", "prefix", "budget", F.shiftright("h", left).alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        ends = _nearest(sums, ["source"])
        open_ = stored(
            ends.select("source", (F.col("budget") - F.col("before")).alias("budget"), F.col("bucket").alias("prefix"), "n"), "level"
        )
        last = open_
        open_ = open_.drop("n")
    limits = last.select(F.col("source").alias("_source"), (F.col("prefix") + F.when(2 * F.col("budget") >= F.col("n"), 1).otherwise(0)).alias("limit"))
    return every.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "passes", F.coalesce("limit", F.lit(0)).alias("limit"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, text, source; others are ignored. Returns doc_id, size (words), source_size, target
    (its source's) and taken: the size times the copies that the mix takes. Null and empty texts have
    size 0; a null source is a source of its own, last in order; rows with equal doc_id, and those
    without one, are decided alike within a source; an empty table gives an empty result. The taken
    words of a source differ from its target by half of one document's size at most, or of one group
    of rows with equal ids. The same rows give the same mix, in any order and on any cluster.
    """
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("size"), unit_hash(F.col("doc_id"), seed).alias("h")), "sized")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    plan = goals.join(
        thresholds(sized, goals).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select(F.col("source").alias("_source"), "source_size", "target", "passes", "limit")
    joined = sized.join(stored(plan, "plan"), F.col("source").eqNullSafe(F.col("_source")))
    copies = F.least(F.col("passes") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0), F.lit(int(most)))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def repeat_by_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """The documents as the mix takes them: left out, once, or as often as its source asks; all columns unchanged.

    Nulls, ties and repeated rows are decided as in ``mix``; a text without words counts nothing and goes
    with its source's passes; an empty table gives an empty result; columns may have any names.
    """
    sized = stored(docs.select("source", word_count("text").alias("size"), unit_hash(F.col("doc_id"), seed).alias("h")), "sized")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    plan = stored(thresholds(sized, goals), "plan").withColumnRenamed("source", "_source")
    joined = packed(docs, "doc_id", "source").join(plan, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("passes") + F.when(unit_hash(F.col("doc_id"), seed) < F.col("limit"), 1).otherwise(0)
    times = F.array_repeat(F.lit(1), F.least(copies, F.lit(int(most))).cast("int"))
    return unpacked(joined.select("_row", F.explode(times)), docs)
