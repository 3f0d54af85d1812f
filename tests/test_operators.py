"""Operators on tables and columns that the driver's tables don't reach."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from atelier.functions import binary, pixels, text
from atelier.operators import aggregates, compare, gaps, names, sequences, trees
from atelier.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("query", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, query):
    df = catalog.queries()[query](spark, SF)
    expected = duck.sql(catalog.oracle_sql()[query])
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    place = [expected.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in expected.fetchall()), key=repr)


@pytest.mark.parametrize("numbers,missing", [([1, 3], "2"), ([1, 5, 6], "2-4"), ([1, 3, 7], "2, 4-6"), ([5, 6, 7], None), ([1, 10**15], "2-999999999999999"), ([None, 2, 2, 4], "3")])
def test_gaps(spark, numbers, missing):
    df = spark.createDataFrame([("a", n) for n in numbers], "g string, n long")
    rows = gaps.ranges_text(gaps.gap_ranges(df, ["g"], "n"), ["g"]).collect()
    assert [r.missing for r in rows] == ([missing] if missing else [])


@pytest.mark.parametrize("given,expected", [("a a a", "a a-2 a-3"), ("A a", "A a-2"), ("a a a-2 a", "a a-2 a-2-2 a-3"), ("a-2 a a", "a-2 a a-3"), ("b-1 B-1 c", "b-1 B-1-2 c")])
def test_collision_names(spark, given, expected):
    df = spark.createDataFrame(list(enumerate(given.split())), "i long, base string")
    got = names.collision_names(df, F.lit(""), F.col("base"), "i").orderBy("i").collect()
    assert [r.name for r in got] == expected.split()


def test_stems(spark):
    df = spark.createDataFrame([("d/Cat.PROCREATE",), (".procreate",), ("x/a.procreate.procreate",), ("b",)], "p string")
    assert [r[0] for r in df.select(names.stem(F.col("p"))).collect()] == ["Cat", ".procreate", "a.procreate", "b"]


def test_prefix_sum_over_stretches(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(-5000, 20_000), r.randrange(10)) for _ in range(500)] + [("a", 7, 1), ("a", 7, 2), (None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = sorted(map(tuple, sequences.prefix_sum(df, ["g"], "k", "v", width=100).collect()), key=repr)
    assert got == sorted(((g, k, v, sum(x for h, j, x in rows if h == g and j < k)) for g, k, v in rows), key=repr)


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, 2), (1, 2, None, 3), (1, 3, "a", 1), (1, 4, None, 1)], "g int, o int, s string, n int")
    got = sequences.runs(df, ["g"], ["o"], ["s"], total="n").orderBy("run").collect()
    assert [(r.s, r.n_rows, r.n) for r in got] == [(None, 2, 5), ("a", 1, 1), (None, 1, 1)]
    assert sequences.changes(df, ["g"], ["o"], ["s"]).count() == 3


def test_differ_text(spark):
    df = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "b", 2), (1, 3, "b", 3)], "g int, o int, x string, y int")
    rows = compare.against_first(df, ["g"], "o", ["x", "y"]).orderBy("o").select(compare.differ_text(F.col("differs"))).collect()
    assert [r[0] for r in rows] == [None, 'field "x" differs', 'fields "x", "y" differ']


def test_tree_ends_cycles_and_depth(spark):
    rows = [(0, "a", None, 1), (0, "b", "a", 2), (0, "x", "y", 1), (0, "y", "x", 1)] + [(1, str(i), str(i - 1) if i else None, 0) for i in range(40)]
    got = trees.flatten(spark.createDataFrame(rows, "tree int, id string, parent string, ord int")).collect()
    assert {r.id for r in got if r.tree == 0} == {"a", "b"} and max(r.depth for r in got) == 31


@pytest.mark.parametrize("n", [0, 1023, 1024, 1075, 1076, 6400, 102348, 102399, 102400, 1048575, 1048576, 5 * 2**40 + 2**38, 2**63 - 1])
def test_human_bytes(spark, n):
    unit, k = 1024, -1
    m, div = n, 1
    while m >= unit:
        m, div, k = m // unit, div * unit, k + 1
    s = n / div
    expected = f"{n} B" if k < 0 else (f"{s:.1f} {'KMGTPE'[k]}iB" if s < 100 else f"{int(s)} {'KMGTPE'[k]}iB")
    assert spark.range(1).select(text.human_bytes(F.lit(n).cast("long"))).first()[0] == expected


def test_binary_numbers(spark):
    df = spark.createDataFrame([(bytearray(bytes.fromhex("00ffeeddccbbaa99")),)], "b binary")
    row = df.select(binary.unsigned_be(F.col("b"), 1, 4), binary.unsigned_be(F.col("b"), 6, 4), binary.unsigned_be_array(F.col("b"), 0, 2, 3, F.lit(3)), binary.is_fourcc(F.lit("avc\n"))).first()
    assert tuple(row) == (0xFFEEDDCC, None, [0x00FF, 0xDDCC, 0xAA99], False)


def test_pixels(spark):
    df = spark.range(1).select(*[pixels.to_byte(F.lit(v)) for v in (-1.0, 0.5, 2.0, float("nan"))], pixels.straight(F.lit(10), F.lit(128)), pixels.over(F.lit(255), F.lit(0), F.lit(128)))
    assert tuple(df.first()) == (0, 128, 255, 0, 20, 127)


def test_best_takes_one_row(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 2, 4)], "g string, x int, y int")
    assert tuple(aggregates.best(df, ["g"], [F.col("x"), F.col("y")], ["y", "x"]).first()) == ("a", 5, 2)


def test_nothing_outside_imports_the_training_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in (root / "atelier").rglob("*.py"):
        if "llm" not in f.parts:
            assert "atelier.llm" not in f.read_text(), f
