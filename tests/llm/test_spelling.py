"""Spelling variants against all pairs of words, and the wavelet matrix against filtering."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from atelier.llm import spelling, wavelet  # noqa: E402
from atelier.llm.queries import OP12_SQL, op12_spelling_variants  # noqa: E402


def near(a, b):
    """Whether a and b differ by exactly one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    deleted = {}
    for w in n:  # words within two edits share a deletion or are one; all pairs of those are compared
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            deleted.setdefault(v, set()).add(w)
    pairs = {w: set() for w in n}
    for group in deleted.values():
        for a in group:
            pairs[a] |= {b for b in group if a != b and near(a, b)}
    form = {}
    for w, others in pairs.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(pairs[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def check(spark, docs, got=None):
    df = got if got is not None else spelling.variants(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, word string, key int, n int"))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == brute(docs)
    return rows


def family(seed, words=60, docs=150):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.choice([6, 7, 8, 9]))) for _ in range(words)]
    weights = [1 / (k + 1) ** 2 for k in range(words)]
    return [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(base, weights, k=200))) for i in range(docs)]


def test_equals_all_pairs(spark):
    rows = check(spark, family(1))
    assert sum(r[1] is not None for r in rows) > 10 and any(r[4] > 2 for r in rows)


def test_chains_of_forms_lead_to_their_end(spark):
    chain = ["aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    docs = [(i, f"{w} {w}") for k, w in enumerate(chain) for i in range(2 * 11**k)]
    rows = {r[0]: r for r in check(spark, docs)}
    assert rows[chain[0]][1:3] == (chain[1], chain[3])


def test_hot_halves_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST", 5)
    monkeypatch.setattr(spelling, "TARGET", 40)
    check(spark, family(2, words=150, docs=60))


def test_awkward_rows(spark):
    long = "xy" * 3000
    docs = [(1, None), (2, ""), (3, " 12 \n"), (None, "letters LETTERS letters"), (None, "lettersA lettersA"), (4, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaab aaaaaab"), (5, long + " " + long), (6, long + "z " + long + "z"),
            (7, "ÀÉÎõüÿ× ÀÉÎõüÿ× àéîõüÿ× àéîõüÿ×"), (7, "ÀÉÎõüÿ× ÀÉÎõüÿ×"), (8, "word " * 5 + "abcdefg " * 300_000 + "abcdefh abcdefh")]
    check(spark, docs)
    check(spark, [])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, docs, op12_spelling_variants(spark, sf))


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    expected = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({OP12_SQL})").fetchall()
    assert sorted(map(tuple, op12_spelling_variants(spark, sf).collect()), key=str) == sorted(expected, key=str)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 64, 65, 1000):
        values = rng.permutation(n)
        lo, low = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300)
        hi, high = lo + rng.integers(-2, 40, 300), low + rng.integers(-2, 40, 300)
        hi, high = np.minimum(hi, n), np.minimum(high, n)
        rect, value = wavelet.WaveletMatrix(values).report(lo, hi, low, high)
        expected = sorted((k, v) for k in range(300) for v in values[lo[k] : max(lo[k], hi[k])].tolist() if low[k] <= v < high[k])
        assert sorted(zip(rect.tolist(), value.tolist(), strict=True)) == expected
