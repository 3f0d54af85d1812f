"""Language identification by unigram piece models that sum over all segmentations of a word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import discard, parts_of, stored

LETTERS = re.compile(r"[^\W\d_]+")
#: Longest piece looked at, longest run of letters scored in one go (longer runs are cut, every letter counts), words of a worker's memory, characters scored at once.
LONGEST, RUN, REMEMBERED, AT_ONCE = 16, 40, 300_000, 2_000_000
FLOOR = 1e-8
#: Factor a letter that keeps a long run's probability within a double; a power of two, so that nothing is rounded.
SCALE = 2.0**13


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the lower-cased text."""
    out = []
    for w in LETTERS.findall((text or "").lower()):
        if w.isascii() or any(map(str.isalpha, w)):
            out.extend([w] if len(w) <= RUN else [w[i : i + RUN] for i in range(0, len(w), RUN)])
    return out


def vocabulary(path: str) -> list[str]:
    """Distinct lower-cased pieces of a SentencePiece model, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    use = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({p for i in use if len(p := sp.id_to_piece(i).lower()) <= LONGEST})


class Segmentations:
    """Probabilities of words, summed over all ways to cut them into pieces, for several languages at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, pieces: list[str], probability: np.ndarray):
        """probability: a row a piece and a column a language."""
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.order = hashes[order], order
        self.longest = max(map(len, pieces))
        self.p = np.vstack([probability, np.zeros(probability.shape[1])])
        self.powers = np.array([pow(int(self.BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)

    @classmethod
    def _hash(cls, piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(cls.BASE) + ord(ch)) % (1 << 64)
        return h

    def _groups(self, words: list[str], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, and hashes of all their prefixes, a word mark before each."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            for at in range(0, len(own), most):
                part = own[at : at + most]
                codes = np.frombuffer("".join("▁" + words[k] for k in part).encode("utf-32-le"), dtype="<u4").reshape(len(part), n + 1)
                prefix = np.zeros((n + 2, len(part)), dtype=np.uint64)
                for k in range(n + 1):
                    prefix[k + 1] = prefix[k] * self.BASE + codes[:, k]
                yield part, prefix

    def _arcs(self, prefix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, end, words and pieces of all arcs of the words' lattices, by end; -1 for a letter that is no piece."""
        for j in range(1, len(prefix)):
            for i in range(max(0, j - self.longest), j):
                h = prefix[j] - prefix[i] * self.powers[j - i]
                at = np.searchsorted(self.sorted, h)
                at[at == len(self.sorted)] = 0
                hit = self.sorted[at] == h
                if i == j - 1:
                    yield i, j, np.arange(len(h)), np.where(hit, self.order[at], -1)
                elif hit.any():
                    m = np.flatnonzero(hit)
                    yield i, j, m, self.order[at[m]]

    def _weights(self, i: int, j: int, ids: np.ndarray) -> np.ndarray:
        """Probabilities of pieces, times ``SCALE`` for each of their letters."""
        p = self.p[ids]
        return (np.maximum(p, FLOOR) if i == j - 1 else p) * SCALE ** (j - i)

    def log_probability(self, words: list[str]) -> np.ndarray:
        """A row a word and a column a language, by the forward algorithm."""
        out = np.empty((len(words), self.p.shape[1]))
        for part, prefix in self._groups(words):
            alpha = np.zeros((len(prefix), len(part), self.p.shape[1]))
            alpha[0] = 1.0
            for i, j, m, ids in self._arcs(prefix):
                alpha[j][m] += alpha[i][m] * self._weights(i, j, ids)
            out[part] = np.log(alpha[-1]) - (len(prefix) - 1) * np.log(SCALE)
        return out

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected number of uses of each piece over the words, by the forward and backward algorithms."""
        total = np.zeros(len(self.p))
        for part, prefix in self._groups(words):
            arcs = [(i, j, m, ids, self._weights(i, j, ids)[:, language]) for i, j, m, ids in self._arcs(prefix)]
            alpha = np.zeros((len(prefix), len(part)))
            beta = np.zeros_like(alpha)
            alpha[0] = beta[-1] = 1.0
            for i, j, m, _, p in arcs:
                alpha[j][m] += alpha[i][m] * p
            for i, j, m, _, p in reversed(arcs):
                beta[i][m] += beta[j][m] * p
            scale = counts[part] / alpha[-1]
            uses = [alpha[i][m] * p * beta[j][m] * scale[m] for i, j, m, _, p in arcs]
            total += np.bincount(np.concatenate([ids for *_, ids, _ in arcs]) % len(total), np.concatenate(uses), len(total))
        return total[:-1]


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, vocabulary_path: str, docs_per_language: int = 600, rounds: int = 3) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and their probabilities (a row a piece, a column a language).

    Learns from text and lang of rows with both, outside the held-out fold, of which some
    ``docs_per_language`` a language are taken by a hash of doc_id: that parameter bounds the sample.
    Words are counted by language in Spark; each round of expectation-maximisation spreads the
    counted words over tasks and sums the expected uses of pieces. The model has a number for each
    piece and language and is all that reaches the driver.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    if not languages:
        return [], pieces, np.zeros((len(pieces), 0))
    keep = F.lit(False)
    for lang in languages:
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(1e6 * min(1.0, docs_per_language / sizes[lang]))))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                words, n = np.unique(np.array(words_of(text), dtype=object), return_counts=True)
                yield pd.DataFrame({"lang": lang, "word": words, "n": n})

    words = rows.where(keep).select("lang", "text").mapInPandas(split, "lang string, word string, n long")
    spark = docs.sparkSession
    # the stored counts are small as files, so that few tasks would read them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    words = counted.repartition(tasks, "word")
    probability = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    column = {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds):
        model = docs.sparkSession.sparkContext.broadcast((pieces, probability))

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            lattice = Segmentations(*model.value)
            whole = np.zeros_like(lattice.p[:-1])
            for pdf in batches:
                for lang, own in pdf.groupby("lang"):
                    whole[:, column[lang]] += lattice.expected(list(own["word"]), own["n"].to_numpy(dtype=float), column[lang])
            some = np.nonzero(whole)
            yield pd.DataFrame({"language": some[1], "piece": some[0], "uses": whole[some]})

        summed = words.mapInPandas(expect, "language int, piece int, uses double").groupBy("language", "piece").agg(F.sum("uses").alias("uses"))
        got = summed.toPandas()  # as many rows as the model has numbers, at most
        uses = np.zeros_like(probability)
        uses[got["piece"], got["language"]] = got["uses"]
        probability = (uses + 0.01) / (uses + 0.01).sum(axis=0)
    discard(spark, counted)
    return languages, pieces, probability


def predict(docs: DataFrame, languages: list[str], pieces: list[str], probability: np.ndarray) -> DataFrame:
    """docs' doc_id with lang_pred and score, from whole texts only."""
    model = docs.sparkSession.sparkContext.broadcast((pieces, probability))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, known, table = Segmentations(*model.value), {}, np.empty((0, len(languages)))
        for batch in batches:
            for part in parts_of(batch, AT_ONCE):
                if len(known) > REMEMBERED:
                    known.clear()
                split = [words_of(t) for t in part.column(1).to_pylist()]
                new = list(filterfalse(known.__contains__, set().union(*split))) if languages else []
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                if len(table) < len(known):  # grows by halves, so that rows are copied a few times only
                    table = np.concatenate([table, np.empty((max(len(known) - len(table), len(table) // 2), len(languages)))])
                table[len(known) - len(new) : len(known)] = lattice.log_probability(new)
                best, chance = [], []
                for words in split:
                    if not words or not languages:
                        best.append("und")
                        chance.append(0.0)
                        continue
                    total = table[[known[w] for w in words]].sum(axis=0)
                    share = np.exp(total - total.max())
                    best.append(languages[int(share.argmax())])
                    chance.append(float(share.max() / share.sum()))
                columns = [part.column(0), pa.array(best, pa.string()), pa.array(chance, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str, docs_per_language: int = 600, rounds: int = 3) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred and score.

    docs: doc_id, text and lang, of which lang is only learned from. Null and empty texts and texts
    without a letter are ``und`` with score 0, and so is everything if nothing can be learned from.
    The score is the chance of the language given the text, all languages being equally likely. A
    null doc_id is not held out and not learned from. Repeated rows are predicted alike; an empty
    table gives an empty result.
    """
    model = train(docs, vocabulary_path, docs_per_language, rounds)
    out = predict(docs, *model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
