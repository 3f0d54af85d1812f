"""Scans over groups that are cut into stretches, one of which holds most rows, against plain Python."""

from __future__ import annotations

import random
from itertools import groupby

import pytest

from atelier.operators import gaps, sequences
from atelier.operators.stretches import Stretches

GROUPS = ("hot", "b", None)


def rows_of(seed=1, n=600):
    """Group, order, symbol, number: three quarters of one group, with sparse order keys, long runs and nulls."""
    r = random.Random(seed)
    orders = r.sample(range(-(10**12), 10**12), n)
    return [(r.choices(GROUPS, (8, 1, 1))[0], o, r.choices(("x", None, "y"), (12, 1, 1))[0], r.randrange(50)) for o in orders]


def by_group(rows):
    return {g: sorted((x for x in rows if x[0] == g), key=lambda x: x[1]) for g in {x[0] for x in rows}}


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_of()
    return rows, spark.createDataFrame(rows, "g string, o long, s string, v long")


def same(got, expected):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_a_hot_group_is_cut_into_even_stretches(data):
    rows, df = data
    cut = Stretches(df, ["g"], ["o"], 40)
    sizes = {(r.g, r._stretch): r["count"] for r in cut.rows.groupBy("g", "_stretch").count().collect()}
    hot = [n for (g, s), n in sizes.items() if g == "hot"]
    assert cut.many and len(hot) >= 8 and max(hot) <= 120 and sum(sizes.values()) == len(rows)


@pytest.mark.parametrize("limit", [40, 1000])
def test_runs_and_changes(data, limit):
    rows, df = data
    expected, first = [], []
    for g, own in by_group(rows).items():
        for k, (s, run) in enumerate(groupby(own, key=lambda x: x[2])):
            run = list(run)
            first.append(run[0])
            expected.append((g, k + 1, s, len(run), run[0][1], run[-1][1], sum(x[3] for x in run)))
    same(sequences.runs(df, ["g"], ["o"], ["s"], total="v", rows=limit), expected)
    same(sequences.changes(df, ["g"], ["o"], ["s"], rows=limit), first)


def test_one_run_of_all_rows(spark):
    df = spark.range(500).selectExpr("1 AS g", "id AS o", "'x' AS s")
    same(sequences.runs(df, ["g"], ["o"], ["s"], rows=20), [(1, 1, "x", 500, 0, 499)])


@pytest.mark.parametrize("limit", [40, 1000])
def test_not_increasing(data, limit):
    rows, df = data
    pairs = [(a, b) for own in by_group(rows).values() for a, b in zip(own, own[1:], strict=False)]
    same(sequences.not_increasing(df, ["g"], ["o"], "v", rows=limit), [b for a, b in pairs if b[3] <= a[3]])
    same(sequences.not_increasing(df, ["g"], ["o"], "v", strict=False, rows=limit), [b for a, b in pairs if b[3] < a[3]])


@pytest.mark.parametrize("limit", [40, 1000])
def test_gaps_sums_and_expansions(spark, data, limit):
    rows, df = data
    holes = [(g, a[1] + 1, b[1] - 1) for g, own in by_group(rows).items() for a, b in zip(own, own[1:], strict=False) if b[1] > a[1] + 1]
    same(gaps.gap_ranges(df, ["g"], "o", rows=limit), holes)
    same(sequences.prefix_sum(df, ["g"], "o", "v", rows=limit), [(*x, sum(y[3] for y in own if y[1] < x[1])) for own in by_group(rows).values() for x in own])
    ties = [(g, v, n) for n, (g, _, _, v) in enumerate(rows)]
    df = spark.createDataFrame(ties, "g string, k long, n long")
    same(sequences.prefix_sum(df, ["g"], "k", "n", rows=limit), [(g, k, n, sum(m for h, j, m in ties if h == g and j < k)) for g, k, n in ties])
    starts = sorted({(g, 3 * v) for g, _, _, v in rows}, key=repr)
    ends = {g: [k for h, k in starts if h == g] for g in GROUPS}
    expected = [(g, k, at) for g, k in starts for at in range(k, min([x for x in ends[g] if x > k], default=201))]
    same(sequences.expand_runs(spark.createDataFrame(starts, "g string, k long"), ["g"], "k", F_lit(200), rows=20 if limit == 40 else limit), expected)


def F_lit(n):
    from pyspark.sql import functions as F

    return F.lit(n).cast("long")


@pytest.mark.parametrize("limit", [60, 1000])
def test_folds_of_sparse_keys(spark, data, limit):
    from pyspark.sql import functions as F

    rows, df = data
    expected = []
    for g, own in by_group(rows).items():
        s = 5
        for x in own:
            s = (s * 3 + x[3]) % 50
        expected.append((g, s))
    same(sequences.fold(df, ["g"], "o", "v", F.lit(5), lambda s, v: (s * 3 + v) % 50, states=50, rows=limit), expected)


def test_numbers_of_all_rows(data):
    rows, df = data
    places = {o: k for k, o in enumerate(sorted(x[1] for x in rows), 1)}
    same(sequences.numbered(df.select("o"), ["o"]), list(places.items()))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, o long, s string, v long")
    assert not sequences.runs(df, ["g"], ["o"], ["s"]).collect() and not gaps.gap_ranges(df, ["g"], "o").collect() and not sequences.prefix_sum(df, ["g"], "o", "v").collect()
