"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the documents' n-grams, summed per document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import discard, hashed_joins, parts_of, setting, stored

#: Words whose hashes a worker remembers, and characters that it splits at once.
REMEMBERED, AT_ONCE = 300_000, 2_000_000
#: Words that make up this share of all words have their counts sent to all tasks: no more than 1 / ``SHARE`` of them, however large the corpus.
SHARE = 1e-5
#: Bigrams are counted and joined in so many blocks, one after the other, so that less is shuffled at once; each block has files of its own.
BLOCKS = 3
#: Files that a task may write side by side; with fewer it would have to sort its rows by block.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Word hashes repeat within a file, so a dictionary of them is worth its place.
FILES = {"parquet.dictionary.page.size": str(8 << 20), "parquet.block.size": str(32 << 20)}


def split(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), cut at ASCII white space."""
    return (text or "").encode().lower().split()


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Block of each bigram, by both of its words' hashes."""
    mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed >> np.uint64(33)) % np.uint64(BLOCKS)).astype(np.int32)


#: Stands for the start of a row; no word is empty.
START = _hash(b"")


def bigrams(docs: DataFrame) -> DataFrame:
    """A row for each distinct bigram of a row of docs: doc_id, a and b (hashes of its words, or of the start), k (its uses), block (by a and b). A row without words has nulls and 0."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        hashes = np.array([START], dtype=np.int64)
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                words = [split(t) for t in part.column(1).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                    hashes = hashes[:1]
                new = list(filterfalse(known.__contains__, set().union(*words)))
                known.update(zip(new, range(len(known) + 1, len(known) + len(new) + 1), strict=True))
                hashes = np.concatenate([hashes, np.fromiter(map(_hash, new), dtype=np.int64, count=len(new))])
                lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                second = np.fromiter((known[w] for own in words for w in own), dtype=np.int64, count=int(lengths.sum()))
                first = np.concatenate([[0], second[:-1]])
                first[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
                row, size = np.repeat(np.arange(len(words), dtype=np.int64), lengths), len(hashes)
                if len(words) * size * size < 1 << 62:
                    packed, k = np.unique((row * size + first) * size + second, return_counts=True)
                    at, pair = packed // (size * size), packed % (size * size)
                else:
                    (at, pair), k = np.unique(np.stack([row, first * size + second]), axis=1, return_counts=True)
                none = np.flatnonzero(lengths == 0)
                gone = np.arange(len(at) + len(none)) >= len(at)
                a, b = (np.concatenate([hashes[x], np.zeros(len(none), dtype=np.int64)]) for x in (pair // size, pair % size))
                columns = [
                    part.column(0).take(pa.array(np.concatenate([at, none]))), pa.array(a, pa.int64(), mask=gone), pa.array(b, pa.int64(), mask=gone),
                    pa.array(np.concatenate([k, np.zeros(len(none), dtype=np.int64)]).astype(np.int32), pa.int32()),
                    pa.array(_block(a, b), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "k", "block"])

    return docs.select("doc_id", "text").mapInArrow(explode, f"doc_id {dict(docs.dtypes)['doc_id']}, a long, b long, k int, block int")


def score(docs: DataFrame, backoff: float = 0.4) -> DataFrame:
    """Stupid-backoff score of every document under the whole corpus.

    docs: doc_id and text; other columns are ignored. Counts of all words and of all bigrams, a row's
    start included, cover all documents. A bigram's own uses in a row are taken off its count, so a
    row doesn't vouch for itself: if some are left, the score is that over the first word's count,
    else ``backoff`` times the second word's share of all words. Words and bigrams are told apart by 64-bit
    hashes.

    Returns doc_id, n_words, n_backoff (words scored by backoff) and score (mean log10 a word, to 9
    digits; null without words). Rows with one doc_id are scored one by one and summed, as parts of
    one document; so are those without doc_id. Null and empty texts have no words; an empty table
    gives an empty result.

    Bigrams that one row alone has are left out of their table, as nothing of them is left for that row.
    Counts are combined before they are shuffled. The words that a large share of rows have in common
    are too few to matter and are looked up without a shuffle; rarer ones, and all bigrams, are
    joined, where rows of a hot bigram are on the side that Spark splits.
    """
    with setting(docs.sparkSession, WRITERS, str(2 * BLOCKS), "0"):
        exploded = stored(bigrams(docs), "bigrams", by=["block"], **FILES)
    uses = exploded.where("b IS NOT NULL")
    begins = F.when(F.col("a") == START, F.col("k")).otherwise(F.lit(0))
    counted = stored(uses.groupBy(F.col("b").alias("w")).agg(F.sum("k").alias("n"), F.sum(begins).alias("begins")), "words")
    total, begun = (n or 0 for n in counted.agg(F.sum("n"), F.sum("begins")).first())
    words = counted.select("w", "n").unionByName(counted.sparkSession.range(1 if begun else 0).select(F.lit(START).alias("w"), F.lit(begun).alias("n")))
    log = lambda c: F.log10(F.col(c).cast("double"))
    low = lambda n: log(n) + F.lit(float(np.log10(backoff) - np.log10(max(total, 1))))
    known = lambda side: words.select(F.col("w").alias(side), F.col("n").alias(f"n_{side}"))
    left = F.col("c") - F.col("k")
    frequent = F.broadcast(words.where(F.col("n") >= F.lit(max(1.0, SHARE * total))).select(F.col("w").alias("b"), "n"))

    def sums(n_words: Column, n_seen: Column, v: Column) -> list[Column]:
        return [n_words.cast("long").alias("n_words"), n_seen.cast("long").alias("n_seen"), v.cast("double").alias("v")]

    none = F.lit(0)
    by_word = [
        exploded.join(frequent, "b", "left").groupBy("doc_id").agg(*sums(F.sum("k"), none, F.sum(F.col("k") * low("n")))),
        uses.join(frequent, "b", "left_anti").select("doc_id", "b", "k").join(known("b"), "b").groupBy("doc_id").agg(*sums(none, none, F.sum(F.col("k") * low("n_b")))),
    ]
    with hashed_joins(docs.sparkSession):
        parts = [stored(part, "sums") for part in by_word]
        for block in range(BLOCKS):
            own = uses.where(F.col("block") == block).withColumn("key", F.xxhash64("a", "b"))
            shared = stored(own.groupBy("a", "b").agg(F.sum("k").cast("long").alias("c"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("a", "b", "c"), "shared")
            counts = shared.join(known("a"), "a").join(known("b"), "b")
            counts = stored(counts.select(F.xxhash64("a", "b").alias("key"), "c", (-log("n_a") - low("n_b")).alias("rest")), "counts")
            seen = own.select("doc_id", "key", "k").join(counts, "key").where(left > 0)
            v = F.sum(F.col("k") * (F.log10(left.cast("double")) + F.col("rest")))
            parts.append(stored(seen.groupBy("doc_id").agg(*sums(none, F.sum("k"), v)), "sums"))
            discard(docs.sparkSession, shared, counts)
        both = reduce(DataFrame.unionByName, parts)
    discard(docs.sparkSession, exploded, counted)
    summed = both.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_seen", "v")])
    mean = F.when(F.col("n_words") > 0, F.round(F.coalesce("v", F.lit(0.0)) / F.col("n_words"), 9))
    return summed.select("doc_id", "n_words", (F.col("n_words") - F.col("n_seen")).alias("n_backoff"), mean.alias("score"))
