"""Connected components of an undirected graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import discard, stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest node of the component of every node that has an edge.

    edges: columns ``a`` and ``b`` (long), in either direction, repeats allowed. Returns ``node`` and
    ``root``. Each round hands every node the least label of its neighbours, passes that on to the
    node that was its label, and then follows one pointer, so a chain of n nodes takes about log n
    rounds. Labels stay in the cluster: the driver sees one sum a round. Edges of a node with many
    neighbours are on the splittable side of a join and are minimised before the next shuffle.
    No edges: an empty frame. Raises if ``max_rounds`` do not suffice.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")),
        "labels",
    )
    before = None
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        seen = labels.join(near, "node")
        offers = seen.select("node", F.least("root", "low").alias("root")).unionByName(
            seen.where(F.col("low") < F.col("root")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        )
        hooked = offers.groupBy("node").agg(F.min("root").alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        last, labels = labels, stored(hooked.join(jump, "root").select("node", F.col("top").alias("root")), "labels")
        discard(edges.sparkSession, last)
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            discard(edges.sparkSession, both)
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
