"""Spelling variants: words that differ by one edit, found by two-dimensional range reporting, and their usual forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import discard, parts_of, stored
from atelier.llm.wavelet import WaveletMatrix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One of so many runs of a document loses a letter.
DAMAGED = 31
#: Distinct words that a worker counts before it hands them on.
HELD = 200_000
#: Characters of text, and rectangles, that a worker handles at once.
AT_ONCE, RECTANGLES = 4_000_000, 200_000
#: Rows that a task's index is made for, and the most rows of one half of a word in one cell; a half that more words share is cut into cells.
TARGET, MOST = 30_000, 15_000


def damaged(doc_id: str, run: str) -> str:
    """A run as the document spells it after damage that depends on both only."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % DAMAGED else run[:at] + run[at + 1 :]


def document_words(doc_id: str, text: str, least: int) -> Iterator[tuple[str, int]]:
    """Words of one text that have ``least`` letters or more, with their numbers; a word may come twice."""
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) >= least:
            word = damaged(doc_id, run.lower() if run.isascii() else run.translate(LOWER))
            if len(word) >= least:
                yield word, n


def vocabulary(docs: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """word and n of all words of ``least`` letters and ``occurrences`` occurrences or more.

    Equal runs of one document are damaged alike, also where they differ in case only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for word, n in document_words(doc_id, text, least):
                        held[word] += n
                    if len(held) >= HELD:
                        yield _counts(held)
                        held.clear()
        yield _counts(held)

    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def halves(words: DataFrame) -> DataFrame:
    """Each word where its near words are looked for: word, n, key, point, asks.

    A key names a length, a side and half of a word: two words of which one has that length and the
    other has it too, or a letter less, and that differ by one edit, share the first half of the longer
    one if the edit is behind it, else the second half. Words of the key's length are points of its index.
    """
    size = F.length("word")

    def place(length: Column, shorter: int) -> list[Column]:
        name = F.lpad(length.cast("string"), 9, "0")
        half = F.floor(length / 2).cast("int")
        front = F.concat(name, F.lit("<"), F.substring("word", F.lit(1), half))
        back = F.concat(name, F.lit(">"), F.substring("word", half + 1 - shorter, length))
        return [F.struct(k.alias("key"), F.lit(not shorter).alias("point")) for k in (front, back)]

    at = F.explode(F.array(*place(size, 0), *place(size + 1, 1))).alias("at")
    return words.select("word", "n", at).select("word", "n", "at.key", "at.point")


def cells(entries: DataFrame, total: int) -> DataFrame:
    """Adds the index (``bucket``) that each entry belongs to, and whether it asks there.

    Halves go to indexes by their hash. A half that more than ``MOST`` entries share is cut into blocks of
    points and blocks of questions; every pair of blocks is a cell of its own, so that all questions
    meet all points and no task holds more than a block of each.
    """
    hot = stored(entries.groupBy("key").count().where(F.col("count") > MOST).select("key", "count", F.ceil(F.col("count") / MOST).alias("cuts")), "hot")
    more = hot.agg(F.sum(F.col("count") * F.col("cuts") * 2)).first()[0] or 0
    buckets = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total + more) // TARGET))
    own, cuts = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"), F.sequence(F.lit(0), F.col("cuts").cast("int") - 1)
    cell = lambda p, q, point, asks: F.struct(p.alias("p"), q.alias("q"), point.alias("point"), asks.alias("asks"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    points = F.when(F.col("point"), F.transform(cuts, lambda c: cell(own, c, yes, no))).otherwise(F.array().cast("array<struct<p int, q int, point boolean, asks boolean>>"))
    grid = F.concat(points, F.transform(cuts, lambda c: cell(c, own, no, yes)))
    dealt = entries.join(hot.select("key", "cuts"), "key", "left")
    one = F.array(cell(zero, zero, F.col("point"), yes))
    dealt = dealt.select("key", "word", "n", F.explode(F.when(F.col("cuts").isNull(), one).otherwise(grid)).alias("c"))
    key = F.concat("key", F.lit("/"), "c.p", F.lit("/"), "c.q")
    return dealt.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), key.alias("key"), "word", "n", "c.point", "c.asks")


class Ordered:
    """Entries in the order of their keys and words, read forwards or backwards.

    ``order`` and ``place`` translate between entries and places; ``shared`` has the number of letters that an
    entry has in common with the one before it, -1 where that has another key; ``points`` the points before a place.
    """

    def __init__(self, keys: list[str], words: list[str], point: np.ndarray) -> None:
        self.order = np.array(sorted(range(len(words)), key=list(map("\0".join, zip(keys, words, strict=True))).__getitem__), int)
        self.place = np.empty(len(words), int)
        self.place[self.order] = np.arange(len(words))
        self.points = np.concatenate([[0], np.cumsum(point[self.order])])
        sizes = np.array([len(w) for w in words], int)
        letters = np.array(list(map(ord, "".join(words))), np.int32)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.shared = np.full(len(words), -1)
        same = np.flatnonzero([keys[b] == keys[a] for a, b in zip(self.order, self.order[1:], strict=False)]) + 1
        a, b, n = self.order[same - 1], self.order[same], 0
        self.shared[same] = np.minimum(sizes[a], sizes[b])
        while same.size:
            more = self.shared[same] > n
            same, a, b = same[more], a[more], b[more]
            equal = letters[begins[a] + n] == letters[begins[b] + n]
            self.shared[same[~equal]] = n
            same, a, b, n = same[equal], a[equal], b[equal], n + 1

    def interval(self, at: np.ndarray, length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Points, as an interval, of the entries that share the first ``length`` letters with the one at a place between lo and hi."""
        cuts = np.append(np.flatnonzero(self.shared[lo:hi] < length) + lo, hi)
        k = np.searchsorted(cuts, at, "right")
        return self.points[cuts[k - 1]], self.points[cuts[k]]


def near_pairs(keys: list[str], words: list[str], point: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that ask and points that differ from them by one replaced letter, or have one letter more; each pair once.

    Where the edit is at letter i, both words have the first i letters and those behind the edit in common:
    the first make an interval in forward order, the latter one in the order of the words read
    backwards. The wavelet matrix over the points in forward order, whose values are their places in the
    other, reports the points in both intervals.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not point.any():
        return np.empty(0, int), np.empty(0, int)
    forward, backward = Ordered(keys, words, point), Ordered(keys, [w[::-1] for w in words], point)
    ahead = forward.order[point[forward.order]]
    back = backward.order[point[backward.order]]
    index = WaveletMatrix(backward.points[backward.place[ahead]])
    length = np.array([int(k[:9]) for k in keys])
    front = np.array([k[9] == "<" for k in keys])
    sizes = np.array([len(w) for w in words])

    waiting: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        entry, lo, hi, low, high, at = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        rect, value = index.report(lo, hi, low, high)
        a, b, i = entry[rect], back[value], at[rect]
        longer = sizes[a] < sizes[b]
        # a letter that stands in a row of its like is taken for the first of them, so that a pair comes once
        first = np.array([k == 0 or words[y][k - 1] != words[y][k] for y, k in zip(b.tolist(), i.tolist(), strict=True)], bool)
        other = np.array([words[x] != words[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        keep = np.where(longer, first, other)
        found.append((a[keep], b[keep]))

    for size in np.unique(length).tolist():
        span = np.flatnonzero(length[forward.order] == size)  # keys begin with the length
        lo, hi = int(span[0]), int(span[-1]) + 1
        own = forward.order[lo:hi][asks[forward.order[lo:hi]]]
        sides = {True: own[front[own]], False: own[~front[own]]}
        for i in range(size):
            entry = sides[i >= size // 2]
            if entry.size:
                ahead_lo, ahead_hi = forward.interval(forward.place[entry], i, lo, hi)
                back_lo, back_hi = backward.interval(backward.place[entry], size - 1 - i, lo, hi)
                some = (ahead_hi - ahead_lo > (point[entry] & asks[entry])) & (back_hi > back_lo)  # others than itself
                if some.any():
                    waiting.append((entry[some], ahead_lo[some], ahead_hi[some], back_lo[some], back_hi[some], np.full(int(some.sum()), i)))
                    if sum(len(x[0]) for x in waiting) >= RECTANGLES:
                        flush()
    if waiting:
        flush()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words that differ by exactly one inserted, deleted or replaced letter, both ways round: word, near, near_n."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        text, n = rows["word"].to_numpy(), rows["n"].to_numpy()
        a, b = near_pairs(rows["key"].tolist(), text.tolist(), rows["point"].to_numpy(bool), rows["asks"].to_numpy(bool))
        turned = np.array([len(x) < len(y) for x, y in zip(text[a], text[b], strict=True)], bool)
        left, right = np.concatenate([a, b[turned]]), np.concatenate([b, a[turned]])
        return pd.DataFrame({"word": text[left], "near": text[right], "near_n": n[right]})

    dealt = cells(halves(words), 4 * words.count())
    return dealt.groupBy("bucket").applyInPandas(pairs, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms: word, root. forms: word, form.

    Pointers are doubled until none moves. Each form has ten times its word's number, so that chains are short and have no circles.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        discard(forms.sparkSession, now)
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10) -> DataFrame:
    """Words with their usual forms: word, form, root, n, n_near, form_n.

    docs: doc_id and text; other columns are ignored. Words are the runs of Latin letters, in lower case as
    far as A-Z go, of which every 31st (by the CRC-32 of document and run) loses a letter; of these the
    results with ``least`` letters and ``occurrences`` occurrences or more. A word's form is its near word with
    the largest n (the smallest of those that tie) if that is ``times`` its own n or more, else null; its root is where
    forms lead in the end, the word itself without one. Null and empty texts have no words; a null
    doc_id counts as empty text; repeated rows count each time. Words of any length are compared whole.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    words = stored(vocabulary(docs, least, occurrences), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    usual = -F.col("best.minus") >= times * F.col("n")
    placed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.minus")).alias("form_n"))
    placed = stored(placed, "forms")
    discard(spark, words)
    ends = roots(placed.where("form is not null"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
