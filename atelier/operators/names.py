"""Names of outputs: stems, numbering of collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.operators.stretches import ROWS, Stretches


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column, extension: str = ".procreate") -> Column:
    """Last element of a path without one trailing extension of any case; a name that is nothing else stays."""
    return F.regexp_replace(base_name(path), rf"(?iu)(?<=.)\Q{extension}\E\z", "")


#: A name that numbering can make of another: that one, a hyphen and a number from 2 without leading zeros.
CHILD = r"(?s)\A(.*)-([2-9]|[1-9][0-9]{1,17})\z"


def _counted(early: DataFrame, late: DataFrame, group: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Rows of ``late`` with the number of rows of ``early`` in their group that come before them; equal ones count.

    Both are laid in one order, in which a prefix sum counts: no row meets another.
    """
    columns = [c for c in late.columns if c not in group and c not in order]
    payload = F.struct(*columns)
    left = early.select(*group, *order, F.lit(0).alias("_late"), F.lit(None).cast(late.select(payload.alias("p")).schema["p"].dataType).alias("_payload"))
    both = left.unionByName(late.select(*group, *order, F.lit(1).alias("_late"), payload.alias("_payload")))
    cut = Stretches(both, group, [*order, "_late"], rows)
    counted = cut.before(cut.rows, 1 - F.col("_late"), "_count").where("_late = 1")
    return counted.select(*group, *order, "_payload.*", F.coalesce("_count", F.lit(0)).cast("long").alias(out))


def _kept(literals: DataFrame, rows: int) -> DataFrame:
    """Which literals keep their name: _dir, _parent, n, kept. literals: those and ``rank``, the parent's requests made before the literal's.

    Requests take the numbers from 2 that no literal has taken before. Request j passes or takes number
    n if j = n - 1 less the literals below n that kept theirs; so n is kept unless that request is one of
    those made before the literal. As that depends on smaller numbers only, it is repeated until it holds: once
    for each time that keeping one name makes the next one be lost, and be kept, in turn.
    """
    now = literals.withColumn("kept", F.lit(True)).checkpoint()
    while True:
        cut = Stretches(now, ["_dir", "_parent"], ["n"], rows)
        below = F.coalesce("_below", F.lit(0))
        found = cut.before(cut.rows, F.col("kept").cast("long"), "_below").withColumn("_next", F.col("n") - 1 - below > F.col("rank"))
        found = found.select("_dir", "_parent", "n", "rank", F.col("_next").alias("kept"), (F.col("_next") != F.col("kept")).alias("_moved")).checkpoint()
        now = found.drop("_moved")
        if found.where("_moved").isEmpty():
            return now


def _resolved(numbered: DataFrame, rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Names that lost their first claim (_dir, _fold), and numbers that requests find taken (_dir, _fold, n); None if no name can be a number of another.

    numbered: _dir, _fold, _order and ``_place`` of each row among those of its name. Requests are all
    rows but a name's first, and that too where the name was given away before. That is known for
    names with k numbers at the end when it is for those with k - 1, so depths are taken in turn.
    """
    claims = numbered.where("_place = 1").select("_dir", "_fold", F.col("_order").alias("_first"))
    named = claims.withColumn("_parent", F.regexp_extract("_fold", CHILD, 1)).withColumn("n", F.regexp_extract("_fold", CHILD, 2).try_cast("long"))
    depth = F.size(F.split(F.regexp_extract("_fold", r"((-[1-9][0-9]*)+)\z", 1), "-")) - 1
    parents = claims.select("_dir", F.col("_fold").alias("_parent"))
    children = named.where("n >= 2").withColumn("_depth", depth).join(parents, ["_dir", "_parent"], "left_semi").checkpoint()
    if children.isEmpty():
        return None
    asking = children.select("_dir", F.col("_parent").alias("_fold")).distinct()
    known = numbered.join(asking, ["_dir", "_fold"], "left_semi").select("_dir", "_fold", "_order", "_place").checkpoint()
    lost, taken = None, None
    for d in sorted(r[0] for r in children.select("_depth").distinct().collect()):  # a number for each length of a name's ending
        level = children.where(F.col("_depth") == d)
        requests = known.where("_place > 1")
        if lost is not None:
            requests = requests.unionByName(known.where("_place = 1").join(lost, ["_dir", "_fold"], "left_semi"))
        requests = requests.select("_dir", F.col("_fold").alias("_parent"), "_order")
        requests = requests.join(level.select("_dir", "_parent").distinct(), ["_dir", "_parent"], "left_semi")
        literals = level.select("_dir", "_parent", F.col("_first").alias("_order"), "n", "_fold")
        ranked = _counted(requests, literals, ["_dir", "_parent"], ["_order"], "rank", rows)
        kept = _kept(ranked.select("_dir", "_parent", "n", "rank"), rows)
        gone = kept.where("not kept").select("_dir", F.concat_ws("-", "_parent", F.col("n").cast("string")).alias("_fold"))
        held = kept.where("kept").select("_dir", F.col("_parent").alias("_fold"), "n")
        lost, taken = (gone, held) if lost is None else (lost.unionByName(gone), taken.unionByName(held))
    return lost, taken


def collision_names(df: DataFrame, folder: Column, base: Column, order: str, out: str = "name", rows: int = ROWS) -> DataFrame:
    """Adds the name that each row gets if names are given in order and taken ones, of any case, get a number.

    A row keeps its name if no earlier row of the folder has got it, else it gets the first of ``name-2``,
    ``name-3`` ... that none has. Its number follows from its place among the requests for that name
    and from the numbers that were taken by rows which are called so themselves (``a-2``), without
    giving out one name after the other: a name, or a family of names that get into each other's
    way, may have any share of the rows. The order key must be unique in a folder.
    """
    keyed = df.select(F.struct("*").alias("_row"), folder.alias("_dir"), base.alias("_base"), F.lower(base).alias("_fold"), F.col(order).alias("_order"))
    cut = Stretches(keyed, ["_dir", "_fold"], ["_order"], rows)
    placed = cut.before(cut.rows, F.lit(1), "_place").withColumn("_place", F.coalesce("_place", F.lit(0)) + 1).drop("_stretch")
    columns = [F.col("_row")[c].alias(c) for c in df.columns]
    numbered = lambda j: F.concat_ws("-", "_base", j.cast("string"))
    found = _resolved(placed.select("_dir", "_fold", "_order", "_place"), rows)
    if found is None:
        return placed.select(*columns, F.when(F.col("_place") == 1, F.col("_base")).otherwise(numbered(F.col("_place"))).alias(out))
    lost, taken = found
    named = placed.join(lost.withColumn("_lost", F.lit(True)), ["_dir", "_fold"], "left")
    request = F.col("_place") - F.when(F.col("_lost"), 0).otherwise(1)
    named = named.select("_row", "_dir", "_base", "_fold", request.alias("_at"))
    # the i-th taken number n stands behind n - 1 - i free ones, so requests from that on go beyond it
    cut = Stretches(taken, ["_dir", "_fold"], ["n"], rows)
    behind = cut.before(cut.rows, F.lit(1), "_i").select("_dir", "_fold", (F.col("n") - 1 - F.coalesce("_i", F.lit(0))).alias("_at"))
    counted = _counted(behind, named.where("_at > 0"), ["_dir", "_fold"], ["_at"], "_passed", rows)
    later = counted.select(*columns, numbered(F.col("_at") + 1 + F.col("_passed")).alias(out))
    return named.where("_at = 0").select(*columns, F.col("_base").alias(out)).unionByName(later)
