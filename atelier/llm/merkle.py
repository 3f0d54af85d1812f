"""Merkle manifest of a dataset: a root over all rows, and for every row the siblings that prove it belongs to that root."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import lower_ascii, stored

FANOUT = 8
#: Levels of the tree that one task collapses at once: a superblock holds FANOUT ** LEVELS nodes at most.
LEVELS = 3

PROOF = "array<struct<at int, others array<string>>>"
PROOF_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


def part(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Hash of a row's values in their order, 64 lower-case hex digits."""
    return F.sha2(F.concat(*map(part, values)), 256)


def parents(nodes: list[str]) -> list[str]:
    """The level above: each FANOUT consecutive digests become the hash of their hex text, as do those that are left at the end."""
    return [hashlib.sha256("".join(nodes[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)]


def collapse(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up to its root. n: nodes of the whole group, which decides how far up it goes."""
    levels = [nodes]
    while len(levels) <= LEVELS if n > FANOUT**LEVELS else len(levels[-1]) > 1:
        levels.append(parents(levels[-1]))
    return levels


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the number of each row in its group from 0, and ``n``, the group's rows.

    Rows are dealt to tasks by ranges of group and order, sorted there and written with their place in
    the task; a row's number follows from its place and from counts a range and group. So a group of
    any size is spread over as many tasks as it fills. Rows equal in all of order may come in any order.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, group, *order, "spread").sortWithinPartitions(group, *order)
    at = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))
    fences = at.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ranges = Window.partitionBy(group).orderBy("_range")  # a row for each task that has rows of the group
    before = F.coalesce(F.sum("_rows").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fences = fences.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return at.join(fences, [group, "_range"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All superblock levels of a forest, and each group's last node.

    nodes: grp, idx, n, node. Every superblock is collapsed to its root by a task of its own, and the
    roots are the nodes of the next round, until each group has one node.
    """

    def collapsed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top = collapse(rows.sort_values("idx")["node"].tolist(), n)[-1][0]
        return pd.DataFrame({"grp": [key[0]], "idx": [key[1]], "n": [-(-n // FANOUT**LEVELS)], "node": [top]})

    levels, tops = [], None
    while True:
        done = nodes.where("n = 1").select("grp", "node")
        tops = done if tops is None else tops.unionByName(done)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return levels, tops
        levels.append(nodes)
        block = F.floor(F.col("idx") / FANOUT**LEVELS).cast("long").alias("block")
        nodes = stored(nodes.select("grp", "idx", "n", "node").groupBy("grp", block).applyInPandas(collapsed, "grp string, idx long, n long, node string"), "nodes")


def _places(size: list[int], local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows at ``local`` in a superblock whose levels have ``size`` nodes: place in the run a level, siblings' numbers (levels laid end to end), and which of these exist."""
    at, others, exist, begins = [], [], [], 0
    for m in size[:-1]:
        at.append(local % FANOUT)
        run = (local - at[-1])[:, None] + np.arange(FANOUT)
        exist.append((run < m) & (run != local[:, None]))
        others.append(run + begins)
        begins, local = begins + m, local // FANOUT
    return np.stack(at, 1), np.concatenate(others, 1), np.concatenate(exist, 1)


def _proofs(lower: pa.Table, upper: pa.Table) -> pa.Array:
    """Proofs of a superblock's nodes (sorted by idx): siblings below its root, then those of the root itself."""
    levels = collapse(lower.column("node").to_pylist(), lower.column("n")[0].as_py())
    local = lower.column("idx").to_numpy() % FANOUT**LEVELS
    at, others, exist = _places([len(x) for x in levels], local)
    above = upper.column("proof")[0].as_py()
    rows, own = at.shape
    pool = [x for level in levels for x in level]
    ends = np.arange(len(pool), len(pool) + sum(len(p["others"]) for p in above))
    pool += [x for p in above for x in p["others"]]
    counts = np.concatenate([exist.reshape(rows, own, FANOUT).sum(2), np.tile(np.array([len(p["others"]) for p in above], int), (rows, 1))], 1)
    chosen = np.concatenate([np.where(exist, others, -1), np.tile(ends, (rows, 1))], 1).ravel()
    siblings = pa.array(pool, pa.string()).take(pa.array(chosen[chosen >= 0], pa.int64()))
    cuts = np.concatenate([[0], counts.ravel().cumsum()]).astype(np.int32)
    places = np.concatenate([at, np.tile(np.array([p["at"] for p in above], int), (rows, 1))], 1).ravel().astype(np.int32)
    steps = pa.StructArray.from_arrays([pa.array(places), pa.ListArray.from_arrays(pa.array(cuts), siblings)], names=["at", "others"])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * counts.shape[1] + 1, counts.shape[1], dtype=np.int32)), steps)


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Proofs of all nodes of a forest's lowest level, with that level's columns.

    tops: grp, proof (of each group's last node; empty if that is the root), subroot and root, which
    are handed down. Each superblock meets the proof of its root and gives its nodes theirs: the
    siblings inside it, followed by the root's. So a task holds a superblock, whatever the dataset's size.
    """
    handed = lambda t: t.select("grp", F.lit(0).cast("long").alias("block"), "proof", "subroot", "root")

    def proven(lower: pa.Table, upper: pa.Table) -> pa.Table:
        lower = lower.drop_columns(["block"]).sort_by("idx").combine_chunks()
        if not lower.num_rows:  # a group that has its last node below this level
            return pa.schema([*lower.schema, ("proof", PROOF_ARROW), ("subroot", pa.string()), ("root", pa.string())]).empty_table()
        same = [pa.array([upper.column(c)[0].as_py()] * lower.num_rows, pa.string()) for c in ("subroot", "root")]
        return lower.append_column("proof", _proofs(lower, upper)).append_column("subroot", same[0]).append_column("root", same[1])

    found, block = handed(tops), F.floor(F.col("idx") / FANOUT**LEVELS).cast("long")
    for k in reversed(range(len(levels))):
        columns = ", ".join(f"`{c}` {t}" for c, t in levels[k].dtypes)
        met = levels[k].withColumn("block", block).groupBy("grp", "block").cogroup(found.groupBy("grp", "block"))
        rows = met.applyInArrow(proven, f"{columns}, proof {PROOF}, subroot string, root string")
        if k:
            lower = stored(rows.select("grp", F.col("idx").alias("block"), "proof", "subroot", "root"), "proofs")
            found = lower.unionByName(handed(tops.join(levels[k].select("grp").distinct(), "grp", "left_anti")))
    return rows


def prove(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds to hashed rows their group's subroot, the root over all, and ``proof``, an array of levels from the row up.

    rows: ``leaf``, a group and columns that order the group; other columns are kept unless they are
    called grp, spread, idx, n, node, block, proof, subroot or root. Of each level the proof has the
    place in its run (``at``) and the run's other digests (``others``), whatever is on the left first.
    Groups are ordered by their text, null first. A group of one row has its leaf as its subroot; the
    only group's subroot is the root. No rows: no rows.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    nodes = stored(rows.withColumns({"grp": named, "spread": F.monotonically_increasing_id(), "node": F.col("leaf")}), "leaves")
    nodes = stored(placed(nodes, "grp", order).drop("spread"), "nodes")
    levels, subroots = climb(nodes)
    subroots = stored(subroots.select(F.col("grp").alias("name"), "node"), "subroots")
    upper = subroots.select(F.lit("").alias("grp"), "name", "node", F.lit(0).alias("spread"))
    upper = stored(placed(upper, "grp", ["name"]).drop("spread"), "subroots")
    above, root = climb(upper)
    empty = F.array().cast(PROOF)
    if above:
        top = root.select("grp", empty.alias("proof"), F.lit("").alias("subroot"), F.col("node").alias("root"))
        proven = stored(descend(above, top), "proofs")
    else:
        proven = upper.select("name", "node", empty.alias("proof"), F.col("node").alias("root"))
    tops = proven.select(F.col("name").alias("grp"), "proof", F.col("node").alias("subroot"), "root")
    lone = nodes.where("n = 1").join(tops, "grp")
    out = [*rows.columns, "proof", "subroot", "root"]
    return descend(levels, tops).select(out).unionByName(lone.select(out)) if levels else lone.select(out)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(acc: Column, level: Column) -> Column:
        left = F.array_join(F.slice(level["others"], F.lit(1), level["at"]), "")
        right = F.array_join(F.slice(level["others"], level["at"] + 1, F.lit(FANOUT)), "")
        return F.sha2(F.concat(left, acc, right), 256)

    return F.aggregate(proof, start, step)


def siblings_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, in its order."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level["others"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, its proof and the roots: doc_id, leaf, altered, subroot, root, proof.

    docs: doc_id, source, lang, n_chars and text; other columns are ignored. A leaf hashes these five in
    that order, groups are languages, ordered by doc_id inside (null first, then equal ids by leaf).
    ``altered`` is the leaf of the document after tampering, which lower-cases A-Z of the text where 3
    divides the CRC-32 of the id's digits; null ids and null texts stay as they are. Nulls have a form
    of their own in a leaf, so null and empty texts differ. Repeated rows are leaves of their own with
    the same digest. An empty table has no rows and no root.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(tampered, leaf(*values[:4], lower_ascii(F.col("text")))).otherwise(F.col("leaf"))
    rows = docs.select(*values).withColumn("leaf", leaf(*values)).select("doc_id", "lang", "leaf", changed.alias("altered"))
    return prove(rows, "lang", ["doc_id", "leaf"]).select("doc_id", "leaf", "altered", "subroot", "root", "proof")


def verification(proven: DataFrame) -> DataFrame:
    """Folds each altered leaf with its original siblings: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    up = proven.withColumn("folded_root", folded(F.col("altered"), F.col("proof")))
    digest = siblings_digest(F.col("proof")).alias("proof_sha256")
    return up.select("doc_id", "leaf", "subroot", "root", digest, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
