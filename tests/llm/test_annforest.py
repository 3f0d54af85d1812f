"""The random-projection forest against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from atelier.llm import annforest  # noqa: E402
from atelier.llm.queries import op13_nearest_neighbours  # noqa: E402


def brute(rows, queries, k=10):
    """Ids and distances of each query's k nearest other ids."""
    out = {}
    for q in queries:
        best = {}
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(v, np.float64) - np.array(own, np.float64)) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, expected):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in e}) for q, e in expected.items()) / sum(map(len, expected.values()))


def same(got, expected):
    assert got.keys() == expected.keys()
    for q, e in expected.items():
        assert [i for _, i in got[q]] == [i for _, i in e]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in e], rtol=1e-12, atol=0)


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows = list(zip(t["vec_id"].tolist(), t["embedding"], strict=True))
    queries = [i for i, _ in rows if i % 100 == 0]
    got, expected = found(op13_nearest_neighbours(spark, sf)), brute(rows, queries)
    assert recall(got, expected) >= 0.95 and all(len(x) == 10 for x in got.values())
    exact = {(q, i): d for q, e in brute(rows, queries[:3], len(rows)).items() for d, i in e}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in queries[:3] for s, i in got[q])


def test_recall_with_few_leaves_visited(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = centres[rng.integers(40, size=4000)] + 0.3 * rng.normal(size=(4000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = found(annforest.neighbours(df, F.col("vec_id") % 100 == 0, search_rows=2500, search_share=0.0, sample=1000))
    assert recall(few, brute(rows, range(0, 4000, 100))) >= 0.9


def test_blocks_and_ties_are_exact(spark, monkeypatch):
    monkeypatch.setattr(annforest, "BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 3)]) for i in range(300)]
    rows = [(i, v) for i, v in rows if any(v)] + [(i, [1.0, 1.0, 1.0]) for i in range(300, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(found(annforest.neighbours(df, F.col("vec_id") % 50 == 0)), brute(rows, [i for i, _ in rows if i % 50 == 0]))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-0.0, 5.0]), (100, [1.0, 1e-20]), (-100, [9.0, 9.0])]
    bad = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [nan, 1.0]), (200, [inf, 1.0]), (None, [1.0, 1.0]), (10, [1.0]), (300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, leaf string, id int, v int")
    same(found(annforest.neighbours(df, F.col("vec_id") % 100 == 0)), brute(good, [0, 100, -100]))


@pytest.mark.parametrize("n", [0, 1, 2, 11])
def test_small_tables(spark, n):
    rows = [(100 * i, [float(i + 1), 1.0]) for i in range(n)]
    got = found(annforest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0))
    same(got, {q: e for q, e in brute(rows, [i for i, _ in rows]).items() if e})


def test_priorities_fall(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(500, 8))
    forest = annforest.grow(data, 16, trees=3)
    sizes = np.bincount(annforest.leaves_of(forest, data).ravel(), minlength=forest.leaves)
    query = rng.normal(size=(1, 8))  # none of the data: medians are points' own projections
    order = annforest.search(forest, sizes, query[0], 10**9)
    assert sorted(order) == list(range(forest.leaves)) and {*order[:3]} == {*annforest.leaves_of(forest, query)[0]}
