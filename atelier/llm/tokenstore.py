"""Token ids in a content-addressed store: chunks by rolling hash, recipes by document, Merkle manifests."""

from __future__ import annotations

import gc
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import filterfalse, islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atelier.llm.common import cleaned, parts_of

#: Ids of a chunk: least, mean beyond the least, most. The rolling hash looks back on fewer ids than the least.
LEAST, MEAN, MOST, REACH = 128, 512, 2048, 16
#: How the store's files are written; small row groups keep writers' memory low.
FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
#: Words whose ids a worker remembers before it starts anew, digests of chunks likewise, and characters that are encoded at once.
REMEMBERED, MET, AT_ONCE = 600_000, 250_000, 1_500_000
#: Where a text has only these characters and none of ``BLANKS``, the library cuts it before each space.
PLAIN = re.compile("[\n -~À-ÖØ-öø-ɏ]*")
#: Texts in which each stop and comma is a piece of its own if it isn't next to another one or after a space; those are cut off, and must end a word.
SIMPLE = re.compile("[\n 0-9A-Za-zÀ-ÖØ-öø-ɏ.,]*")
STOPS = {".": "\1", ",": "\2"}
TWINS = ("..", ".,", ",.", ",,", " .", " ,")
INSIDE = (re.compile("\1[^ \n]"), re.compile("\2[^ \n]"))
MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
#: Blanks that the library may take as one piece; so it does with those that end a text.
BLANKS, ENDS = ("  ", "\n ", " \n", "\n\n\n"), (" ", "\n\n")


class Encoder:
    """Ids of texts as little-endian numbers of ``width`` bytes.

    A byte-level model encodes what stands between two cuts of its pattern on its own, and the
    pattern always cuts before a single space, so words that were seen before are not encoded
    again. Texts for which that might not hold, and texts with the name of a special token, go
    whole to the library, which decides what such a name stands for.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.names = [t.content for t in self.library.get_added_tokens_decoder().values()]
        top = max(self.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.width = 2 if top <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.end = end_id.to_bytes(self.width, "little")
        self.known: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}
        self._restart({})
        self.spaced = np.zeros(top, dtype=bool)
        self.spaced[[i for token, i in self.library.get_vocab().items() if token[0] == "Ġ"]] = True  # how the vocabulary writes a space

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in encoded]  # tasks run on little-endian machines

    def _plain(self, text: str) -> bool:
        """Whether the library cuts a text of ``PLAIN`` characters before each space and line end."""
        return not any(x in text for x in BLANKS) and not text.endswith(ENDS) and not any(n in text for n in self.names)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters with a space before each: encoded in lines and cut where a token starts with the space."""
        out = []
        for at in range(0, len(words), 256):
            line = words[at : at + 256]
            raw = self._library([" " + " ".join(line)])[0]
            starts = np.flatnonzero(self.spaced[np.frombuffer(raw, dtype=f"<u{self.width}")]) * self.width
            if len(starts) != len(line):
                raise ValueError("the tokenizer doesn't keep words apart at spaces")
            ends = [*starts[1:].tolist(), len(raw)]
            out.extend(raw[i:j] for i, j in zip(starts.tolist(), ends, strict=True))
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of words that weren't met before; marks after letters are a piece of their own."""
        letters, others = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        marked = {w: m.groups() for w in others if (m := MARKED.fullmatch(w))}
        stops = list(filterfalse(self.stops.__contains__, {mark for _, mark in marked.values()}))
        self.stops.update(zip(stops, self._library(stops), strict=True))
        letters += filterfalse(self.known.__contains__, {x for x, _ in marked.values()}.difference(letters))
        self.known.update(zip(letters, self._words(letters), strict=True))
        self.known.update((w, self.known[x] + self.stops[mark]) for w, (x, mark) in marked.items())
        rest = [w for w in others if w not in marked]
        self.known.update(zip(rest, self._library([w if w[:1] == "\n" else " " + w for w in rest]), strict=True))

    def _restart(self, known: dict[str, bytes]) -> None:
        self.known = known | dict(zip(STOPS.values(), self._library(list(STOPS)), strict=True))
        self.stops.clear()

    def _spaced(self, text: str) -> str | None:
        """A plain text with a space wherever the library cuts it, None for another text; the words after the first have a space before them, a line end or a mark in front."""
        simple = SIMPLE.fullmatch(text) is not None
        if not (simple or PLAIN.fullmatch(text)) or not self._plain(text):
            return None
        if simple and not any(x in text for x in TWINS):
            marked = text
            for stop, mark in STOPS.items():
                marked = marked.replace(stop, " " + mark)
            if not any(p.search(marked) for p in INSIDE):
                text = marked
        return text.replace("\n", " \n")

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts end to end, and how many each text has, the end id included."""
        gc.disable()  # what is made here has no cycles, and looking for them takes as long as the work
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        if len(self.known) > REMEMBERED:  # the words met first, and so the frequent ones, stay
            self._restart(dict(islice(self.known.items(), REMEMBERED // 2)))
        texts = [t or "" for t in texts]
        spaced = [self._spaced(t) for t in texts]
        odd = list({t for t, s in zip(texts, spaced, strict=True) if s is None})
        whole = dict(zip(odd, self._library(odd), strict=True))
        # no space comes before the first word; an odd text counts as one word
        first = self._library([s.partition(" ")[0] if s else "" for s in spaced])
        heads = [whole[t] if s is None else f for t, s, f in zip(texts, spaced, first, strict=True)]
        cut = pc.split_pattern(pa.array([s or "" for s in spaced], pa.large_string()), " ")
        starts = cut.offsets.to_numpy()[:-1]
        later = np.ones(len(cut.values), dtype=bool)
        later[starts] = False
        told = cut.values.filter(pa.array(later)).dictionary_encode()  # each distinct word is looked up once
        words = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        self._learn([words[i] for i in new])
        for i in new:
            found[i] = self.known[words[i]]
        ids = [*found, *heads, self.end]
        # the words of all texts as numbers of ``ids``: a text's head, its later words, the end id
        numbers = np.empty(len(later), dtype=np.int64)
        numbers[later] = told.indices.to_numpy()
        numbers[starts] = len(words) + np.arange(len(texts))
        stops = np.append(starts[1:], len(later))[: len(texts)]
        numbers = np.insert(numbers, stops, len(ids) - 1)
        flat = np.frombuffer(b"".join(ids), dtype=f"<u{self.width}")
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.width
        own = lengths[numbers]
        ends = np.cumsum(own)
        places = np.repeat((np.cumsum(lengths) - lengths)[numbers] - (ends - own), own) + np.arange(int(own.sum()))
        upto = ends[stops + np.arange(len(texts))]
        return flat[places], np.diff(upto, prepend=0).tolist()


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker, so that what it remembers serves the next task too."""
    return Encoder(path, end_id)


def _mixed(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit word for each id below n."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def candidates(ids: np.ndarray, words: np.ndarray) -> list[int]:
    """Places after which a chunk may end, ascending. Each depends on the REACH ids before it only, which lie in the chunk."""
    if len(ids) < REACH:
        return []
    h, k = words[ids & (len(words) - 1)], 1
    while k < REACH:  # sums over twice as many ids each time
        h[k:] += h[:-k] << np.uint64(k)
        k *= 2
    return (np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + 1).tolist()


def cuts(places: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the stream between two places, given the candidates: the first after LEAST ids, MOST at most."""
    out = []
    while stop - start > LEAST:
        i = bisect_left(places, start + LEAST)
        start = min(stop, start + MOST, places[i] if i < len(places) else stop)
        out.append(start)
    if start < stop:
        out.append(stop)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over leaves; leaves and branches are told apart by a first byte."""
    level = [sha256(b"\0" + x).digest() for x in leaves] or [sha256(b"").digest()]
    while len(level) > 1:
        pairs = [sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes every whole text and writes the store under ``path``.

    docs: doc_id and text (null: empty); other columns are ignored, repeated rows are stored again as
    recipes only, null doc_ids come first. Every document ends in ``end_id``. The store:

    chunks/   digest, width, data: each distinct chunk once; data has ids of ``width`` bytes, little-endian
    recipes/  part, row, doc_id, n_tokens, root, digests: ascending by doc_id over the parts, and in each;
              root is the Merkle root of the document's digests
    manifest/ part, n_docs, n_tokens, root: the Merkle root of the roots of a part's documents

    A task writes a chunk that it met before as its digest only, so that a large group of copies
    reaches the shuffle that finds chunks of several tasks once a task.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words, met = encoder_of(tokenizer, end_id), _mixed(1 << 16), set()
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                ids, n = encoder(part.column(1).to_pylist())
                pa.default_memory_pool().release_unused()  # workers stay, and so would what Arrow keeps
                whole, width = ids.tobytes(), encoder.width
                places = candidates(ids, words)
                roots, digests, chunks, at = [], [], [], 0
                ends_of, ends_new = [0], [0]
                for own in n:
                    first = len(digests)
                    for end in cuts(places, at, at + own):
                        piece = whole[at * width : end * width]
                        digest = sha256(piece).digest()
                        digests.append(digest)
                        if digest not in met:
                            if len(met) > MET:
                                met.clear()
                            met.add(digest)
                            chunks.append((digest, piece))
                        at = end
                    roots.append(merkle(digests[first:]))
                    ends_of.append(len(digests))
                    ends_new.append(len(chunks))
                fields = [pa.array([d for d, _ in chunks], pa.binary()), pa.array([width] * len(chunks), pa.int32()), pa.array([x for _, x in chunks], pa.binary())]
                data = pa.ListArray.from_arrays(pa.array(ends_new, pa.int32()), pa.StructArray.from_arrays(fields, names=["digest", "width", "data"]))
                recipe = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(digests, pa.binary()))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(roots, pa.binary()), recipe, data]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "root", "digests", "chunks"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, root binary, digests array<binary>, chunks array<struct<digest:binary,width:int,data:binary>>"
    staging = f"{path}/staging"
    docs.select("doc_id", "text").mapInArrow(encode, schema).write.options(**FILES).parquet(staging)
    staged = spark.read.schema(schema).parquet(staging)
    ranged = staged.select("doc_id", "n_tokens", "root", "digests").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    rows = ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens", "root", "digests")

    def rooted(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("row")
        return pd.DataFrame([[own["part"].iloc[0], len(own), own["n_tokens"].sum(), merkle(list(own["root"]))]], columns=["part", "n_docs", "n_tokens", "root"])

    with cleaned(spark):
        staged.select(F.inline("chunks")).repartition("digest").dropDuplicates(["digest"]).write.options(**FILES).parquet(f"{path}/chunks")
        rows.write.options(**FILES).parquet(f"{path}/recipes")
        _delete(spark, staging)
        parts = spark.read.parquet(f"{path}/recipes").select("part", "row", "n_tokens", "root").groupBy("part")
        parts.applyInPandas(rooted, "part int, n_docs long, n_tokens long, root binary").write.parquet(f"{path}/manifest")


@lru_cache(maxsize=4096)
def _shift(n: int) -> int:
    """x to the power 8n modulo the CRC's polynomial, bits reversed as zlib has them."""
    square, out = 1 << 23, 1 << 31  # x^8 and 1
    while n:
        if n & 1:
            out = _product(square, out)
        square = _product(square, square)
        n >>= 1
    return out


def _product(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo the CRC's."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=4096)
def _shifts(length: int) -> list[list[int]]:
    """For each byte of a CRC and each value of it, what it becomes ``length`` bytes later."""
    one = [_product(_shift(length), 1 << bit) for bit in range(32)]
    out = []
    for byte in range(4):
        table = [0]
        for bit in range(8):
            table += [x ^ one[8 * byte + bit] for x in table]
        out.append(table)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from that of each and the second's length."""
    if not first:
        return second
    a, b, c, d = _shifts(length)
    return a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24] ^ second


def _checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n (ids) and crc (of the ids as 4-byte words) of every chunk, after its data was held against its digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for digest, width, data in zip(pdf["digest"], pdf["width"], pdf["data"], strict=True):
                if sha256(data).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(data, dtype=f"<u{width}").astype("<u4")
                rows.append((digest, len(ids), crc32(ids.tobytes())))
            yield pd.DataFrame(rows, columns=["digest", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").mapInPandas(read, "digest binary, n int, crc long")


def report(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold for each document: doc_id, start, n_tokens, ids_crc32.

    Every chunk is read and verified once; a document's CRC is put together from those of its chunks
    in the order of its recipe, so no ids are shuffled and a chunk that many documents share costs
    those documents some bytes each. A damaged or missing chunk, a recipe that doesn't match its root,
    or one whose ids don't add up, ends the job with an error.
    """
    manifest = spark.read.parquet(f"{path}/manifest")  # one row a part
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = manifest.select("part", before.alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spark.read.parquet(f"{path}/recipes").withColumn("inside", inside).join(F.broadcast(offsets), "part")
    once = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    each = placed.select("row", "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    own = ("doc_id", "start", "n_tokens", "root")
    by_doc = (
        each.select("row", *map(once, own), "pos", "digest")
        .join(_checked_chunks(spark, path), "digest", "left")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc", "digest"))).alias("parts"), *(F.max(c).alias(c) for c in own))
    )

    @F.pandas_udf("long")
    def crc_of(parts: pd.Series, n_tokens: pd.Series, root: pd.Series) -> pd.Series:
        out = []
        for own, n, top in zip(parts, n_tokens, root, strict=True):
            if any(pd.isna(p["n"]) for p in own) or sum(p["n"] for p in own) != n:
                raise ValueError("a document's chunks are missing or don't add up")
            if merkle([p["digest"] for p in own]) != top:
                raise ValueError("a document's recipe doesn't match its root")
            crc = 0
            for p in own:
                crc = joined_crc(crc, int(p["crc"]), 4 * int(p["n"]))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    return by_doc.select("doc_id", "start", "n_tokens", crc_of("parts", "n_tokens", "root").alias("ids_crc32"))


def root(spark: SparkSession, path: str) -> str:
    """Merkle root of the whole store, over the roots of its parts (one row a part)."""
    parts = spark.read.parquet(f"{path}/manifest").orderBy("part").select("root").collect()
    return merkle([bytes(r[0]) for r in parts]).hex()


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose recipes don't match the manifest, or that one of the two doesn't have; none for a whole store, and for an empty one."""

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("row")
        return pd.DataFrame([[own["part"].iloc[0], merkle(list(own["root"]))]], columns=["part", "root"])

    recipes = spark.read.parquet(f"{path}/recipes").select("part", "row", "root")
    found = recipes.groupBy("part").applyInPandas(again, "part int, root binary")
    manifest = spark.read.parquet(f"{path}/manifest").select("part", F.col("root").alias("expected"))
    return manifest.join(found, "part", "full").where(~F.col("root").eqNullSafe(F.col("expected"))).select("part")


def read(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id and ids (array of int) of the documents, or of those in ``doc_ids``, rebuilt from their chunks.

    Repeated rows and rows without doc_id are each given back; with ``doc_ids``, those without one are not.
    An empty text has the end id only. A missing chunk ends the job with an error.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    wanted = recipes if doc_ids is None else recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")

    @F.pandas_udf("array<int>")
    def ids_of(parts: pd.Series) -> pd.Series:
        out = []
        for own in parts:
            if any(p["data"] is None for p in own):
                raise ValueError("a chunk is missing")
            out.append(np.concatenate([np.frombuffer(p["data"], dtype=f"<u{p['width']}").astype("int32") for p in own]))
        return pd.Series(out)

    return (
        wanted.select("row", "doc_id", F.posexplode("digests").alias("pos", "digest"))
        .join(spark.read.parquet(f"{path}/chunks"), "digest", "left")
        .groupBy("row", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "width", "data"))).alias("parts"))
        .select("doc_id", ids_of("parts").alias("ids"))
    )
