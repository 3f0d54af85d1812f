"""Trees held as rows with a parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sorts after any order number, so that a folder's record follows its children.
LAST = 2147483647


def flatten(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """Adds depth and path to the nodes that hang together with a root, in an order that sorts siblings backwards.

    nodes: tree, id, parent (null for roots), ord (place among siblings, first on top). path is the
    array of ``-ord`` from the root, so sorting by it lists the bottom-most first. Levels beyond ``depth``
    are left out, and so are cycles and nodes whose parent is missing. Each round joins every node with
    the ancestor that it has reached, whose own way up is as long, so ``depth`` levels take the logarithm
    of it in rounds.
    """
    ways = nodes.select("tree", "id", F.col("parent").alias("top"), F.array(-F.col("ord")).alias("path"))
    for _ in range(max(1, (depth - 1).bit_length())):
        above = ways.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        risen = ways.join(above, (F.col("tree") == F.col("_tree")) & (F.col("top") == F.col("_id")), "left")
        ended = F.col("top").isNull()
        ways = risen.where(ended | F.col("_id").isNotNull()).select(
            "tree", "id", F.when(~ended, F.col("_top")).alias("top"), F.when(ended, F.col("path")).otherwise(F.concat("_path", "path")).alias("path")
        )
    whole = ways.where(F.col("top").isNull() & (F.size("path") <= depth)).select("tree", "id", (F.size("path") - 1).alias("depth"), "path")
    return nodes.join(whole, ["tree", "id"])


def records(flat: DataFrame) -> DataFrame:
    """Records of a flattened tree: a divider (3) before a folder's children, the folder (1) after them, leaves (0); tree, id, section, key.

    flat: the columns of ``flatten`` and is_folder. Sorting by key gives the order of the records.
    """
    cols = lambda section, key: ["tree", "id", F.lit(section).alias("section"), key.alias("key")]
    folders = flat.where("is_folder")
    divider = folders.select(*cols(3, F.col("path")))
    closing = folders.select(*cols(1, F.concat("path", F.array(F.lit(LAST)))))
    return flat.where("not is_folder").select(*cols(0, F.col("path"))).unionByName(divider).unionByName(closing)
