"""The pipeline on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hits int, _row string, fp long, size int, component_id long, variant int, kept string"


def write(spark, path, docs, items, labels):
    spark.createDataFrame([(*d, 1, 2, "r", 3, 4, 5, 6, "k") for d in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


def test_awkward_rows(spark, tmp_path):
    leaked = text(77, 12)
    docs = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, text(4), "en", "a"), (4, text(4), "en", "a"), (5, text(4), "de", "b"), (6, text(6), None, None),
        (None, text(7), "en", "a"), (None, text(8), "en", "b"), (9, text(9) + " " + leaked.upper() + " end", "en", "a"), (10, text(10, 60_000), "en", "b"), (11, text(11) + " é 日本 <|endoftext|>", "fr", "c"),
    ]
    write(spark, str(tmp_path), docs, [(1, leaked), (None, None), (2, "")], [(4, 1, None), (4, 0, 0), (None, 1, 1), (6, None, 1)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {4, 6, 10, 11, None} and 10 in {r.doc_id for r in out}
    assert sorted(r.start for r in out) == [sum(x.n_tokens for x in sorted(out, key=lambda r: r.start)[:k]) for k in range(len(out))]
    docs_in = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_in, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == [1, 10, 11, 4, 6, 9, None, None]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs_in, str(tmp_path))
        assert got.columns == docs_in.columns, name
        assert {(r._hits, r._row, r.fp, r.size, r.component_id, r.variant, r.kept) for r in got.collect()} == {(2, "r", 3, 4, 5, 6, "k")}, name


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
