"""Near copies by their five-word shingles: ball hashing of SimHash fingerprints finds pairs, exact Jaccard similarity decides.

Fingerprints have a fixed length, so among very many texts those of strangers meet by chance, with the square of
their number. So a fingerprint only meets others that have the same least (or greatest) hash of a shingle:
strangers have none in common, near copies at 0.8 have it in four cases of five.

Where very many texts meet in one variant, as texts made from a template do, those texts are compared
exactly, in blocks, so that no pair is lost and none leaves a task for being in a crowd.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atelier.llm.common import discard, parts_of, split_by_ids, stored
from atelier.llm.components import connected_components

#: Independent fingerprints a text, and bits of each. Two fingerprints of ``BITS`` bits lie in one long.
PRINTS, BITS = 12, 28
LANES = PRINTS // 2
#: Bits of a fingerprint that have to meet; all of them are counted when two sets are compared.
MEET = 20
#: Two texts at similarity 0.8 differ in 15.2 % of their fingerprints' bits, 50.9 of 336 with a deviation of 6.6.
MOST_BITS = 80
#: Members of a bucket of which all pairs are compared. Texts of fuller buckets are searched by their shingles instead.
SMALL = 8
#: Shingles in a block of a crowd's sets, and how many of them are counted at once.
BLOCK, COLUMNS = 400_000, 4096
#: Characters of text that a worker handles at once.
AT_ONCE = 4_000_000


def shingles(text: str | None, size: int = 5) -> set[bytes]:
    """Distinct runs of ``size`` words (A-Z in lower case, cut at ASCII white space); a shorter text is one."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(s) for s in zip(*(words[i:] for i in range(size)), strict=False)}


def prints(own: set[bytes]) -> tuple[int, list[int], list[int]]:
    """Hash of a set of shingles, its fingerprints, two in a number, and for each fingerprint the least or greatest hash of a shingle (0 without shingles)."""
    h = _set_of(own)
    lanes = np.empty((len(h), LANES), dtype="<u8")
    for k in range(LANES):  # splitmix64
        z = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes[:, k] = z ^ (z >> np.uint64(31))
    ones = np.zeros(64 * LANES, dtype=np.int64)
    for lo, hi in pairwise([*range(0, len(h), 255), len(h)]):  # 255 ones fit a byte
        ones += np.unpackbits(lanes[lo:hi].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    bits = np.packbits(2 * ones > len(h), bitorder="little").view("<i8") & ((1 << 2 * BITS) - 1)
    ends = np.stack([lanes.min(axis=0), lanes.max(axis=0)], axis=1) if len(h) else np.zeros((LANES, 2), dtype="<u8")
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(h.tobytes())))), bits.tolist(), ends.astype("<u8").view("<i8").ravel().tolist()


def _set_of(own: set[bytes]) -> np.ndarray:
    """The shingles of a set as 64-bit hashes."""
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own), dtype="<u8", count=len(own)))


def _identified(docs: DataFrame, *columns: str) -> DataFrame:
    """Documents with ``row_id``, a hash of id and text: one for rows that are repeated only."""
    return docs.select(*columns, "text", F.xxhash64("doc_id", "text").alias("row_id"))


def _printed(docs: DataFrame) -> DataFrame:
    """doc_id, row_id, set_id (one for all texts with the same shingles), n (distinct shingles), the fingerprints f0, f1, ... and their shingles' hashes m0, m1, ..."""
    lanes = _lanes()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                ids, sizes, own = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text)
                    set_id, f, m = prints(s)
                    ids.append(set_id)
                    sizes.append(len(s))
                    own.append(f + m)
                columns = [part.column(0), part.column(2), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*own, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_id", "set_id", "n", *lanes])

    kind = dict(docs.dtypes)["doc_id"]
    return _identified(docs, "doc_id").mapInArrow(compute, f"doc_id {kind}, row_id long, set_id long, n int, " + ", ".join(f"{f} long" for f in lanes))


def _lanes() -> list[str]:
    """Columns of fingerprints, two in each, and of the shingles' hashes, one for each fingerprint."""
    return [f"f{k}" for k in range(LANES)] + [f"m{k}" for k in range(PRINTS)]


def _keyed(sets: DataFrame) -> DataFrame:
    """Every fingerprint's ``MEET`` bits with all that differ from them in one bit, each with the fingerprint's shingle, as one hash: variant, b (the set).

    A fingerprint whose shingle no other set has meets none and is left out. Shingles are counted where
    they are, and told by a map of bits, so rows of a frequent one don't move for that.
    """
    bits = lambda k: F.shiftright(f"f{k // 2}", BITS * (k % 2)).bitwiseAND(F.lit((1 << MEET) - 1)) + F.lit(k << MEET)
    each = sets.select(F.col("set_id").alias("b"), F.inline(F.array(*(F.struct(bits(k).alias("bits"), F.col(f"m{k}").alias("shingle")) for k in range(PRINTS)))))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("shingle")
    maybe, _ = split_by_ids(each, shared, "shingle")
    flips = F.lit([0, *(1 << b for b in range(MEET))]).cast("array<long>")
    ball = maybe.select("b", "bits", "shingle", F.explode(flips).alias("flip"))
    return ball.select(F.xxhash64("shingle", F.col("bits").bitwiseXOR(F.col("flip"))).alias("variant"), "b")


def _buckets(keyed: DataFrame) -> DataFrame:
    """Members b of every variant that several sets have: whether the bucket is crowded, and if not, its members before and after b."""
    ordered = Window.partitionBy("variant").orderBy("b")
    # of a bucket with more than SMALL members, each one has as many around it
    around = F.count(F.lit(1)).over(ordered.rowsBetween(-SMALL, SMALL))
    beside = lambda step: F.array_compact(F.array(*(step("b", k).over(ordered) for k in range(1, SMALL))))
    sized = keyed.select("b", around.alias("n"), beside(F.lag).alias("before"), beside(F.lead).alias("after")).where("n > 1")
    few = lambda c: F.when(F.col("n") <= SMALL, F.col(c)).alias(c)
    return sized.select("b", few("before"), few("after"), (F.col("n") > SMALL).alias("crowded"))


def candidates(sets: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of sets of which one of the fingerprints differs in two of ``MEET`` bits or fewer and has the same shingle, and all bits together in few; and the sets of crowded buckets.

    Every set emits the ball of radius one around each of its fingerprints; two fingerprints within two
    bits meet in a variant, if their least (or greatest) shingle is the same. In buckets of up to ``SMALL`` members all pairs are made, but for those of two
    members of fuller ones, wherever they meet: these are returned as ``set_id`` and ``crowded`` compares all of them.
    So members of a crowd make no pairs among themselves, and variants are shuffled once.
    """
    spark, lanes = sets.sparkSession, range(LANES)
    buckets = stored(_buckets(_keyed(sets)), "buckets")
    crowd = stored(buckets.where("crowded").select(F.col("b").alias("set_id")).distinct(), "crowd")
    of_crowd = lambda name: crowd.select(F.col("set_id").alias(name))
    alone = buckets.where("NOT crowded").join(of_crowd("b"), "b", "left_anti")
    maybe, _ = split_by_ids(alone.select(F.explode("after").alias("a"), "b"), of_crowd("a"), "a")
    met = alone.select(F.explode("before").alias("a"), "b").unionByName(maybe.join(of_crowd("a"), "a", "left_semi")).distinct()
    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("n").alias(f"n_{s}"), *(F.col(f"f{k}").alias(f"{s}{k}") for k in lanes))
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in lanes), F.lit(0))
    near = (differ <= MOST_BITS) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    pairs = stored(met.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), "candidates")
    discard(spark, buckets)
    return pairs, crowd


def gathered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingles of the wanted sets as hashes: set_id, hashes. wanted: set_id and row_id, a row that has the set.

    Rows that no set concerns are told by a map of bits and stay where they are.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, AT_ONCE, text=0):
                own = [pa.array(_set_of(shingles(t)).view("<i8")) for t in part.column(0).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.concat_arrays(own))
                yield pa.RecordBatch.from_arrays([part.column(1), lists], names=["row_id", "hashes"])

    maybe, _ = split_by_ids(_identified(docs), wanted.select("row_id"), "row_id")
    rows = maybe.select("text", "row_id").mapInArrow(hashed, "row_id long, hashes array<long>").join(wanted, "row_id")
    return rows.groupBy("set_id").agg(F.first("hashes").alias("hashes"))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Pairs with both sides' hashes (a_h, b_h) and whether their Jaccard similarity is ``similarity`` or more (linked)."""
    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("hashes").alias(f"{s}_h"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("a_h", "b_h")))
    return rows.withColumn("linked", F.col("both") >= similarity * (F.size("a_h") + F.size("b_h") - F.col("both"))).drop("both")


def joined(left: np.ndarray, own: np.ndarray, other: np.ndarray, sizes: np.ndarray, flat: np.ndarray, similarity: float) -> np.ndarray:
    """Of sets laid end to end, the least one that each of ``own`` or ``other`` is linked with through these two blocks; itself without one.

    left: the set of each of ``flat``'s shingles. Overlaps of all pairs between the blocks are counted exactly, by
    products of their membership matrices, some thousand shingles at a time.
    """
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    rows, columns = left[shared], rank[column[shared]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((len(own), len(other)), np.float32)
    for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        some = slice(*np.searchsorted(columns, [lo, lo + COLUMNS]))
        member = np.zeros((len(sizes), COLUMNS), np.float32)
        member[rows[some], columns[some] - lo] = 1
        both += member[own] @ member[other].T
    near = (both > 0) & (both >= similarity * (sizes[own][:, None] + sizes[other][None, :] - both))
    label = np.arange(len(sizes))
    while True:
        last = label.copy()
        label[own] = np.minimum(label[own], np.where(near, label[other][None, :], len(sizes)).min(1, initial=len(sizes)))
        label[other] = np.minimum(label[other], np.where(near, label[own][:, None], len(sizes)).min(0, initial=len(sizes)))
        if (label == last).all():
            return label


def crowded(sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links a, b between sets that join the same classes as all links at ``similarity`` or more. sets: set_id, hashes.

    All sets are compared, in blocks: those of similar sizes, as no others can be linked, each pair of blocks in
    a task of its own, which holds two blocks and returns one link a set at most, however many it has.
    So nothing grows with the square of a crowd but the comparisons themselves, of which a core makes
    some millions a second.
    """
    size = F.size("hashes")
    level = F.floor(F.log(size) / float(np.log(1 / similarity)) + 1e-9).cast("int")
    sized = sets.where(size > 0).select("set_id", "hashes", level.alias("level"))
    totals = sized.groupBy("level").agg(F.sum(F.size("hashes")).alias("all"))
    # a row for each factor of 1 / similarity in size
    counts = totals.select("level", F.greatest(F.ceil(F.col("all") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    near = lambda k, name: counts.select((F.col("level") + k).alias("level"), F.col("blocks").alias(name))
    known = sized.join(F.broadcast(counts), "level").join(F.broadcast(near(-1, "above")), "level", "left").join(F.broadcast(near(1, "below")), "level", "left")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    cell = lambda low, i, j, side: F.struct(low.alias("low"), F.lit(side // 2).alias("up"), i.alias("i"), j.alias("j"), F.lit(side % 2 == 1).alias("second"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    k = F.col("level")
    cells = F.concat(
        F.transform(F.filter(upto("blocks"), lambda j: j >= own), lambda j: cell(k, own, j, 0)), F.transform(F.filter(upto("blocks"), lambda i: i < own), lambda i: cell(k, i, own, 1)),
        F.transform(upto("above"), lambda j: cell(k, own, j, 2)), F.transform(upto("below"), lambda i: cell(k - 1, i, own, 3)),
    )
    dealt = known.select("set_id", "hashes", F.explode(cells).alias("c")).select("c.*", "set_id", "hashes")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, lists = rows.column("set_id").to_numpy(), rows.column("hashes").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        second = rows.column("second").to_numpy()
        one = not rows.column("up")[0].as_py() and rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        own, other = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        label = joined(np.repeat(np.arange(len(ids)), sizes), own, other, sizes, lists.flatten().to_numpy(), similarity)
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[label[linked]], "b": ids[linked]})

    return dealt.groupBy("low", "up", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (smallest doc_id) of every document's class of near copies.

    docs: doc_id and text; other columns are ignored. Texts are linked where the Jaccard similarity of
    their distinct five-word shingles (as 64-bit hashes) is ``similarity`` or more; classes are what links
    reach. Texts with the same shingles, and those without words (null, empty, blank), are one before
    pairs are sought; a text of five words or fewer is one shingle. Repeated rows are of one class; a null
    doc_id takes part in links but never names a class; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    printed = stored(_printed(docs), "prints")
    lanes = [F.first(c).alias(c) for c in _lanes()]
    sets = stored(printed.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min("row_id").alias("row_id"), F.first("n").alias("n"), *lanes), "sets")
    pairs, crowd = candidates(sets.where("n > 0"), similarity)
    used = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(crowd).distinct()
    hashes = stored(gathered(docs, sets.join(used, "set_id").select("set_id", "row_id")), "hashes")
    links = compared(pairs, hashes, similarity).where("linked").select("a", "b")
    if not crowd.isEmpty():
        links = links.unionByName(crowded(hashes.join(crowd, "set_id"), similarity))
    links = stored(links, "links")
    discard(spark, hashes, pairs, crowd)
    roots = connected_components(links).select(F.col("node").alias("set_id"), "root")
    placed = sets.join(roots, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "first_id")
    classes = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return printed.select("doc_id", "set_id").join(placed.join(classes, "root").select("set_id", "component_id"), "set_id").select("doc_id", "component_id")
