"""SimHash near-duplicate classes by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import split_by_ids, stored
from atelier.llm.components import connected_components

BITS = 64
#: Shingle hashes that are counted at once; bounds memory on very long texts.
BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one text: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [xxh(b" ".join(words), seed)]
    else:
        hashes = [xxh(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i : i + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprint column, computed in Arrow batches."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle, seed) for t in texts], dtype="int64")

    return hashed(text)


def ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` flipped bits of a fingerprint, itself first."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.from_json(F.lit(str(signed)), "array<bigint>"), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links between distinct fingerprints at ``distance`` or fewer differing bits that join the same classes as all such links.

    distinct: column ``fp``, no repeats. Each fingerprint emits the ball of half the distance; two
    that differ in ``distance`` bits or fewer meet in a variant. Members of a variant's bucket all
    lie within half the distance of it, hence within ``distance`` of each other, so each is linked
    with the least member only; a bucket holds no more distinct fingerprints than a ball. Links are
    verified by their bits and repeated ones removed. Distances must be even.
    """
    if distance % 2 or distance < 0:
        raise ValueError("the distance must be even")
    met = (
        distinct.select("fp", F.explode(ball(F.col("fp"), distance // 2)).alias("variant"))
        .groupBy("variant")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Class of near duplicates of every document.

    docs: ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, fingerprint (16
    lower-case hex digits), component_id (smallest doc_id reachable over links, its own included)
    and class_size (rows in the class). Null, empty and blank texts have fingerprint zero and are
    linked like any other. A null doc_id is kept and takes part in links, but never names a class; a
    class of nulls only has a null component_id. Repeated rows are kept. An empty table gives an
    empty result. Exact copies are one fingerprint before anything is shuffled, so groups of copies
    of any size cost one row.
    """
    prints = stored(docs.select("doc_id", fingerprint("text", shingle, seed).alias("fp")), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = connected_components(links(distinct.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "n")
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("class_size"))
    by_print = placed.select("fp", "root").join(named, "root").select("fp", "component_id", "class_size")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_size"
    )


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents without all but one of each class: the one with the smallest doc_id stays.

    Rows that share the doc_id of a document that stays are repeats of it and one of them stays.
    Rows without a doc_id stay.
    """
    return without_copies(docs, near_duplicates(docs.select("doc_id", "text"), distance))


def without_copies(docs: DataFrame, named: DataFrame) -> DataFrame:
    """As keep_one, by classes that are already known: doc_id and component_id of every document.

    Rows that share a doc_id are one document: they go if one of them does, else one of them stays.
    Only documents whose id may be that of one that goes or is repeated are joined with those ids; all
    others stay where they are, so that texts aren't shuffled for a decision of one bit.
    """
    classes = stored(named.select("doc_id", "component_id"), "classes")
    stays = F.col("doc_id") == F.col("component_id")
    counted = classes.groupBy("doc_id").agg(F.count_if(stays).alias("stay"), F.count_if(~stays).alias("go"))
    special = stored(counted.where("go > 0 or stay > 1").select("doc_id", (F.col("go") > 0).alias("gone")), "special")
    maybe, others = split_by_ids(docs, special.select("doc_id"), "doc_id")
    kept = others.unionByName(maybe.join(special, "doc_id", "left_anti").select(docs.columns))
    repeated = special.where("not gone").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(maybe.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
