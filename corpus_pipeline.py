"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atelier.llm import decontaminate, mixing, nearcopies, quality, simhash, tokenstore
from atelier.llm.common import fresh_path, stored, table
from atelier.llm.queries import end_id, tokenizer_file


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules reject go.

    Null, empty and blank texts are too short and go; repeated rows stay or go together; rows without
    doc_id are judged but not learned from; without labels only the base rules reject.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, by five-word shingles at similarity 0.8, stays: that with the smallest doc_id.

    Rows that share a doc_id are one document, of which one row stays; rows without doc_id stay; texts
    without words are one class.
    """
    return simhash.without_copies(docs, nearcopies.near_copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; items without words have no windows; with no benchmark all stay.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, taken once or repeated, as their source's target asks.

    A null source is one of its own; texts without words have size 0, so that taking them changes nothing;
    rows with one doc_id are taken alike.
    """
    return mixing.repeat_by_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns what its files hold for each document.

    A null text is empty and has the end id only; rows without doc_id come first; repeated rows follow
    each other and share their chunks.
    """
    path = fresh_path(spark, "tokens")
    tokenstore.write(docs, path, tokenizer_file(), end_id=end_id())
    return tokenstore.report(spark, path)


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token-id output", tokens),
]

#: SimHash classes and token ids can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next.

    Extra columns pass through all stages but the last, whatever their names; an empty table gives an
    empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
