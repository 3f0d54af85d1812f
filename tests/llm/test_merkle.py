"""The Merkle manifest against a plain Python tree, on awkward rows, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from atelier.llm import merkle  # noqa: E402
from atelier.llm.queries import OP11_SQL, op11_merkle_manifest  # noqa: E402

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string, idx int, spread int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """Rows of the query; each level's run of a node is looked up anew."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for d, source, lang, n, text in rows:
        leaf = sha("".join(map(part, (d, source, lang, n, text))))
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[lang].append((d is not None, d or 0, leaf, sha("".join(map(part, (d, source, lang, n, lower(text) if hit else text))))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            lo = i - i % 8
            out.append((level[lo:i], level[i + 1 : lo + 8]))
            i //= 8
        return out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    high = tree([low[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (known, d, leaf, changed) in enumerate(sorted(groups[g])):
            steps = path(low[g], i) + path(high, k)
            for before, after in steps:
                changed = sha("".join(before) + changed + "".join(after))
            proof = sha("".join("".join(b + a) for b, a in steps))
            out.append((d if known else None, leaf, low[g][-1][0], high[-1][0], proof, changed, changed == high[-1][0]))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCS)
    got = merkle.verification(merkle.manifest(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    return got


def test_awkward_rows(spark):
    rows = [(i, "s", None if i % 7 == 0 else "é" if i % 3 else "en", i, f"Text {i} É") for i in range(700)]
    rows += [(3, "s", "é", None, None), (3, "s", "é", None, ""), (3, "s", "é", None, ""), (None, None, None, None, None), (-5, "s", "lone", 1, "A"), (10**15 + 1, "", "", 0, "LONG " * 300_000)]
    check(spark, rows)


def test_many_groups_need_levels_of_their_own(spark):
    check(spark, [(i, "s", f"g{i % 600}", i, "Ab") for i in range(1500)])


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 512, 513, 4097])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert check(spark, rows).count() == n


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    expected = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({OP11_SQL})").fetchall()
    got = [tuple(r) for r in op11_merkle_manifest(spark, sf).collect()]
    assert sorted(got) == sorted(expected) and {r[-1] for r in got} == {True, False}
