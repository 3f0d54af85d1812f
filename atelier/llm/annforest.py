"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue a query over all trees, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import stored

#: Trees, and vectors that a leaf is meant to hold.
TREES, LEAF_ROWS = 16, 128
#: Vectors that a query meets before its search ends, repeats over trees included: so many, or this share of all if that is more.
#: Vectors without any structure (uniform directions in 64 dimensions) need the share for a recall above 0.9 at any size; clustered ones do with far less.
SEARCH_ROWS, SEARCH_SHARE = 10_000, 0.6
#: Leaves that a query visits, about, at most; where it meets more vectors than those of so many leaves, leaves hold more instead, so that what comes out of them grows with the queries only.
VISITS = 100
#: Vectors that the trees are fitted on, about, and the fewest of them in a leaf. So a forest has TREES * SAMPLE / LEAST leaves at most, whatever the table's size.
SAMPLE, LEAST = 100_000, 8
#: Vectors of a leaf that one task holds; larger leaves are cut into blocks, all of which a query visits.
BLOCK = 50_000
SHARES = 1 << 20


@dataclass
class Forest:
    """Inner nodes of all trees. A child below zero is the leaf ``-1 - child``; leaves are numbered through all trees."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int


def grow(sample: np.ndarray, leaf_rows: int, trees: int = TREES, seed: int = 11) -> Forest:
    """A forest over a sample: each node projects its vectors on the line through two random ones of them and cuts at the median."""
    planes: list[np.ndarray] = []
    cuts: list[float] = []
    children: list[list[int]] = []
    roots, leaves = [], 0
    for tree in range(trees):
        rng = np.random.default_rng((seed, tree))
        slot: tuple[int, int] | None = None
        todo = [(np.arange(len(sample)), slot)]
        while todo:
            rows, slot = todo.pop()
            plane = cut = None
            if len(rows) > leaf_rows:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b
                along = sample[rows] @ plane
                cut = float(np.median(along))
                low = along < cut
                if not low.any():  # ties at the median
                    low = along <= cut
                    cut = float(np.nextafter(cut, np.inf))
                if low.all():
                    plane = None
            if plane is None:
                number, leaves = -1 - leaves, leaves + 1
            else:
                number = len(cuts)
                planes.append(plane)
                cuts.append(cut)
                children.append([0, 0])
                todo += [(rows[low], (number, 0)), (rows[~low], (number, 1))]
            if slot is None:
                roots.append(number)
            else:
                children[slot[0]][slot[1]] = number
    width = sample.shape[1]
    return Forest(np.array(planes).reshape(-1, width), np.array(cuts), np.array(children, int).reshape(-1, 2), roots, leaves)


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector in every tree."""
    out = np.empty((len(vectors), len(forest.roots)), np.int64)
    for k, root in enumerate(forest.roots):
        node = np.full(len(vectors), root)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            along = np.einsum("ij,ij->i", vectors[inner], forest.planes[at])
            node[inner] = forest.children[at, (along >= forest.cuts[at]).astype(int)]
        out[:, k] = -1 - node
    return out


def search(forest: Forest, sizes: np.ndarray, query: np.ndarray, rows: int) -> list[int]:
    """Leaves of a query, best first, until they hold ``rows`` vectors.

    One priority queue holds nodes of all trees. A node's priority is the least margin by which the
    query lies on its side of the cuts above it, negative where it lies on the other side.
    """
    queue: list[tuple[float, int]] = [(-np.inf, root) for root in forest.roots]
    found, held = [], 0
    while queue and held < rows:
        worst, node = heapq.heappop(queue)  # priorities negated
        if node < 0:
            found.append(-1 - node)
            held += sizes[-1 - node]
            continue
        plane = forest.planes[node]
        margin = float((query @ plane - forest.cuts[node]) / np.sqrt(plane @ plane))
        near, far = forest.children[node][::-1] if margin >= 0 else forest.children[node]
        heapq.heappush(queue, (max(worst, -abs(margin)), int(near)))
        heapq.heappush(queue, (max(worst, abs(margin)), int(far)))
    return found


def matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def nearest(queries: np.ndarray, own: list[int], vectors: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[int, int, float]]:
    """For each query its k nearest ids with exact distances; each vector has its least ids, in order."""
    first = np.array([x[0] for x in ids])
    for query, query_id in zip(queries, own, strict=True):
        apart = vectors - query
        score = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        rows = np.arange(len(score))
        if len(score) > k + 1:
            rows = np.flatnonzero(score <= np.partition(score, k)[k])
        rows = rows[np.lexsort((first[rows], score[rows]))][: k + 1]  # one may be the query's own
        found = sorted((float(score[r]), x) for r in rows for x in ids[r] if x != query_id)
        yield from ((query_id, x, s) for s, x in found[:k])


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", leaf_rows: int = LEAF_ROWS, search_rows: int = SEARCH_ROWS, search_share: float = SEARCH_SHARE, sample: int = SAMPLE) -> DataFrame:
    """The k nearest other rows that each query finds: query_id, rank, vec_id, score (Euclidean distance).

    vectors: an integer key and an array of numbers; other columns are ignored. All vectors are indexed in
    all trees; queries are the rows where ``is_query``, a condition on the key, holds. Vectors that are
    null, empty or zero or hold a null or a non-finite number take no part, nor do rows without a key, nor
    vectors of any but the most frequent length (of equally frequent ones the smallest). Equal vectors
    are one in the index, with their k + 1 least keys: no query needs more of them, however many
    there are. Ties go to the smaller key. Rows that share a key are one item with several vectors, whose
    smallest distance counts; repeated rows change nothing. A table with k other rows or fewer gives all
    of them; an empty one gives no rows. Reruns agree.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    own = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), own.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = lengths["width"] if lengths else 1
    rows = rows.where(F.size("v") == width)

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(batch.num_rows, width) + np.zeros(1, kind)  # -0 is 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "v"])

    packed = rows.mapInArrow(binary, "id long, v binary")
    least = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    limited = packed.withColumn("_rank", least).where(F.col("_rank") <= k + 1)
    items = stored(limited.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    n = items.count()
    share = SHARES if n <= sample else int(SHARES * sample / n)
    some = items.where(F.pmod(F.xxhash64("v"), F.lit(SHARES)) < share).orderBy("v").select("v").toPandas()["v"]
    data = np.frombuffer(b"".join(some), kind).reshape(-1, width).astype(np.float64)
    budget = max(search_rows, round(search_share * n))
    forest = grow(data, max(LEAST, round(max(leaf_rows, budget / VISITS) * len(data) / max(n, 1))))
    sent = spark.sparkContext.broadcast(forest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = leaves_of(sent.value, matrix(batch.column(0), kind))
                for t in range(leaf.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t]), *batch.columns], names=["leaf", "v", "ids"])

    index = stored(items.mapInArrow(assign, "leaf long, v binary, ids array<long>"), "index")
    counts = index.groupBy("leaf").count().toPandas()  # a row a leaf, which are bounded
    sizes = np.zeros(forest.leaves, np.int64)
    sizes[counts["leaf"].to_numpy(int)] = counts["count"].to_numpy(int)
    met = spark.sparkContext.broadcast(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [search(sent.value, met.value, q, budget) for q in matrix(batch.column(1), kind)]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                blocks = [-(-met.value[leaf] // BLOCK) for f in found for leaf in f]
                leaf = pa.array([leaf for f in found for leaf in f], pa.int64())
                yield pa.RecordBatch.from_arrays([leaf, pa.array(blocks, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "blocks", "query_id", "q"])

    asked = rows.withColumnRenamed("id", key).where(is_query).select(F.col(key).alias("id"), "v").mapInArrow(binary, "id long, v binary")
    queries = asked.repartition("v", "id").mapInArrow(visit, "leaf long, blocks long, query_id long, q binary")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    large = spark.createDataFrame([(int(i), int(-(-c // BLOCK))) for i, c in enumerate(sizes) if c > BLOCK], "leaf long, blocks long")
    cut = index.join(F.broadcast(large), "leaf", "left")
    blocks = cut.select("leaf", F.coalesce(F.pmod(F.xxhash64("v"), F.col("blocks")), F.lit(0)).cast("long").alias("block"), "v", "ids")

    def rerank(lower: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if lower.num_rows and asked.num_rows:
            found = list(nearest(matrix(asked.column("q"), kind), asked.column("query_id").to_pylist(), matrix(lower.column("v"), kind), lower.column("ids").to_pylist(), k))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    near = blocks.groupBy("leaf", "block").cogroup(queries.groupBy("leaf", "block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    scored = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
