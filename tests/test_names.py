"""Numbering of names that get into each other's way, against giving them out one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from atelier.operators import names


def one_by_one(rows):
    """rows: folder, base, order."""
    used, out = set(), []
    for folder, base, order in sorted(rows, key=lambda r: r[2]):
        name, n = base, 2
        while (folder, name.lower()) in used:
            name, n = f"{base}-{n}", n + 1
        used.add((folder, name.lower()))
        out.append((folder, base, order, name))
    return sorted(out)


def check(spark, rows, limit):
    df = spark.createDataFrame(rows, "folder string, base string, o long")
    got = names.collision_names(df, F.col("folder"), F.col("base"), "o", rows=limit)
    assert sorted(map(tuple, got.collect())) == one_by_one(rows)


@pytest.mark.parametrize("limit", [25, 10_000])
def test_mixed_families_of_any_size(spark, limit):
    r = random.Random(limit)
    rows = []
    for o in range(400):
        base = r.choice(["a", "A", "a", "b", "a-2-2"]) if r.random() < 0.5 else f"a-{r.randrange(0, 60)}" if r.random() < 0.8 else f"a-{r.randrange(2, 9)}-{r.randrange(2, 9)}"
        rows.append((r.choices(["hot", "other"], (9, 1))[0], base, o * 7))
    check(spark, rows, limit)


def test_many_small_mixes(spark):
    r = random.Random(9)
    pool = ["x", "X", "x-2", "x-3", "x-2-2", "x-02", "x-1", "x-0", "x-3-2", "-2", "", "x-999999999999999999999", "y-2"]
    check(spark, [(f"d{k}", r.choice(pool), o) for k in range(60) for o in range(12)], 10_000)


def test_names_kept_and_lost_in_turn(spark):
    """Requests alternate with literals, so that each decision hangs on the one before it."""
    rows, o = [("d", "a", 0)], 1
    for n in range(2, 40):
        rows += [("d", "a", o), ("d", f"a-{n}" if n % 2 else f"a-{41 - n}", o + 1)]
        o += 2
    check(spark, rows, 10)


def test_empty(spark):
    df = spark.createDataFrame([], "folder string, base string, o long")
    assert not names.collision_names(df, F.col("folder"), F.col("base"), "o").collect()
