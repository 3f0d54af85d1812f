"""Valid and covered lines by a sweep over blocks, against sets of lines."""

from __future__ import annotations

import random

import pytest

from atelier.sources import coverage


def brute(rows):
    out = {}
    for file, first, last, count in rows:
        package = "." if "/" not in file else file.rpartition("/")[0].replace("/", "_")
        valid, covered = out.setdefault((package, file), (set(), set()))
        valid |= set(range(first, last + 1))
        if count > 0:
            covered |= set(range(first, last + 1))
    return sorted((p, f, len(v), len(c)) for (p, f), (v, c) in out.items())


@pytest.mark.parametrize("limit", [30, 10_000])
def test_sweep_equals_sets_of_lines(spark, limit):
    r = random.Random(3)
    rows = []
    for _ in range(500):
        first = r.randrange(3000)
        rows.append((r.choices(["a/b/hot.go", "x.go", "never/hit.go"], (10, 1, 1))[0], first, first + r.choice([0, 0, 1, 5, 40, 700]), r.choice([0, 0, 1, -2, 7])))
    rows = [(f, a, b, 0 if f == "never/hit.go" else n) for f, a, b, n in rows] + rows[:20]  # repeated blocks
    df = spark.createDataFrame(rows, "file string, first long, last long, count long")
    swept = coverage.swept(df, stretch=limit)
    assert sorted(map(tuple, swept.select("package", "file", "valid", "covered").collect())) == brute(rows)
    by_lines = coverage.rates(coverage.line_hits(df)).collect()
    assert sorted(map(tuple, coverage.rolled(swept).collect()), key=repr) == sorted(map(tuple, by_lines), key=repr)


def test_a_block_of_a_billion_lines(spark):
    df = spark.createDataFrame([("f", 1, 10**9, 0), ("f", 5, 6, 1), ("f", 10**9, 10**9 + 1, 2)], "file string, first long, last long, count long")
    assert tuple(coverage.swept(df).first()) == (".", "f", 10**9 + 1, 4)
    assert not coverage.swept(df.where("false")).collect()
