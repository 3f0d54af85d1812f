"""Benchmark decontamination with a broadcast set of test n-grams, in DataFrame operations only."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import lower_ascii, packed, unpacked

#: A word of a lower-cased text: ASCII letters and digits, and anything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct test windows that are sent to all tasks at most; beyond that, windows are shuffled and joined.
MAX_SENT = 20_000


def words(text: Column) -> Column:
    """Words of the lower-cased text; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(ITEM_WORD), F.lit(0)), F.array().cast("array<string>"))


def _joined(ws: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(ws, start + 1, n), " ")


def _hash(ws: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(ws, start + k) for k in range(n)])


def _starts(ws: Column, n: int) -> Column:
    """0-based starts of all windows of n words."""
    return F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))


def test_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct windows of all items: n (words), w (text), h (hash), items (sorted item_ids as strings, nulls left out).

    A short item is one window of all its words; an item without words has none.
    """
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    each = split.select("item", "ws", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("ws") - n)).alias("at"))
    sliced = each.select("item", "n", F.slice("ws", F.col("at") + 1, F.col("n")).alias("s"))
    hashed = F.lit(None).cast("long")
    for k in range(1, window + 1):
        hashed = F.when(F.col("n") == k, _hash(F.col("s"), F.lit(0), k)).otherwise(hashed)
    return (
        sliced.select("item", "n", F.array_join("s", " ").alias("w"), hashed.alias("h"))
        .groupBy("n", "w", "h")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _covered(hits: Column) -> Column:
    """Words that sorted spans [s, e) cover, each counted once."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, h: F.struct(
        F.greatest(acc["end"], h["e"]).alias("end"),
        (acc["n"] + F.greatest(h["e"] - F.greatest(h["s"], acc["end"]), F.lit(0))).cast("long").alias("n"),
    )
    return F.aggregate(hits, none, step, lambda acc: acc["n"])


HITS = "array<struct<s:int,e:int,items:array<string>>>"


def _scan_sent(docs: DataFrame, found: list, text: str) -> DataFrame:
    """Adds _ws and _hits: the hash set and the windows travel with the plan, so nothing is shuffled."""
    # a generator's rows, as a projection would be written out again wherever a filter on _hits names it
    split = docs.select("*", F.explode(F.array(words(F.col(text)))).alias("_ws"))
    spans = [F.array().cast(HITS)]
    for n in sorted({r["n"] for r in found}):
        own = sorted((r for r in found if r["n"] == n), key=lambda r: r["h"])
        sent = F.from_json(
            F.lit(json.dumps({"h": [r["h"] for r in own], "w": [r["w"] for r in own], "i": [r["items"] for r in own]})),
            "h array<bigint>, w array<string>, i array<array<string>>",
        )
        hashes = [r["h"] for r in own]
        ws = F.col("_ws")
        maybe = F.filter(_starts(ws, n), lambda i: _hash(ws, i, n).isin(hashes))  # noqa: B023
        place = F.transform(
            maybe,
            lambda i: F.struct(i.alias("s"), F.array_position(sent["h"], _hash(ws, i, n)).cast("int").alias("p"), _joined(ws, i, n).alias("w")),  # noqa: B023
        )
        # windows with one hash stand next to each other
        twins = max(Counter(hashes).values())
        of = lambda c, k: F.when(F.get(sent["w"], c["p"] - 1 + k) == c["w"], F.get(sent["i"], c["p"] - 1 + k))  # noqa: B023, E731
        found_items = F.transform(
            place,
            lambda c: F.struct(c["s"].alias("s"), (c["s"] + n).alias("e"), F.coalesce(*[of(c, k) for k in range(twins)]).alias("items")),  # noqa: B023
        )
        spans.append(F.filter(found_items, lambda h: h["items"].isNotNull()).cast(HITS))
    # sorted in two steps: spans by their start, which struct order does
    return split.withColumn("_hits", F.array_sort(F.concat(*spans)))


def _scan_joined(docs: DataFrame, windows: DataFrame, lengths: list[int], text: str) -> DataFrame:
    """Adds _ws and _hits: windows of distinct texts are shuffled by their hash and joined with the test windows."""
    keyed = docs.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("_ws", words(F.col(text)))
    ws, parts = F.col("_ws"), F.array().cast("array<struct<n:int,s:int,h:bigint,w:string>>")
    for n in lengths:
        own = F.transform(
            _starts(ws, n),
            lambda i: F.struct(F.lit(n).alias("n"), i.alias("s"), _hash(ws, i, n).alias("h"), _joined(ws, i, n).alias("w")),  # noqa: B023
        )
        parts = F.concat(parts, own)
    hits = (
        keyed.select("_key", F.inline(parts))
        .join(windows, ["n", "h", "w"])
        .groupBy("_key")
        .agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e"), "items"))).cast(HITS).alias("_hits"))
    )
    joined = keyed.join(hits, "_key", "left")
    return joined.withColumn("_hits", F.coalesce("_hits", F.array().cast(HITS))).drop("_key")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, max_sent: int = MAX_SENT) -> DataFrame:
    """docs with _ws (words) and _hits (sorted spans of words in which a test window occurs, with its items).

    A hash set of the windows goes to all tasks if there are no more than ``max_sent`` of them; every
    text is then scanned in place, without a shuffle, and hits are verified word by word. A larger
    benchmark is joined by a shuffle instead, with the same result; a hot window then is on the side
    of the join that Spark splits.
    """
    windows = test_windows(benchmark, window)
    found = windows.limit(max_sent + 1).collect()
    if len(found) > max_sent:
        lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most ``window`` of them
        return _scan_joined(docs, windows, sorted(lengths), text)
    return _scan_sent(docs, found, text)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_sent: int = MAX_SENT) -> DataFrame:
    """How much of each document is benchmark text.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns doc_id, n_words,
    n_hit (words inside an occurring window), n_items (items with occurring windows), items_sha256
    (of those item_ids, sorted as strings, comma-joined) and contaminated. Null and empty texts have
    no words; repeated rows are reported alike; a null item_id hits but is not an item; empty tables
    give empty or clean results.
    """
    scanned = scan(docs.select("doc_id", "text"), benchmark, "text", window, max_sent)
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    counted = scanned.select(
        "doc_id", F.size("_ws").cast("long").alias("n_words"), _covered(F.col("_hits")).alias("n_hit"), items.alias("_items")
    )
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_sent: int = MAX_SENT) -> DataFrame:
    """The documents in which no test window occurs, all columns unchanged.

    Null and empty texts stay; repeated rows stay or go together; items without words have no windows;
    without items all stay; columns may have any names.
    """
    scanned = scan(packed(docs, "text"), benchmark, "text", window, max_sent)
    return unpacked(scanned.where(F.size("_hits") == 0), docs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_sent: int = MAX_SENT) -> DataFrame:
    """All documents, without the words inside occurring windows; what stands between words stays.

    Null texts stay null; a text that is a window as a whole keeps what stands around its words; else as
    ``remove_documents``.
    """
    scanned = scan(packed(docs, "text"), benchmark, "text", window, max_sent)
    raw = scanned.withColumn("_raw", F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0))).withColumn("_gaps", F.split("text", RAW_WORD, -1))
    hit = lambda i: F.exists("_hits", lambda h: (h["s"] <= i) & (i < h["e"]))
    text = F.array_join(
        F.transform("_gaps", lambda gap, i: F.concat(gap, F.when(hit(i), F.lit("")).otherwise(F.coalesce(F.get("_raw", i), F.lit(""))))), ""
    )
    clean = F.when(F.size("_hits") > 0, text).otherwise(F.col("text"))
    return unpacked(raw, docs, text=clean)
