"""The corpus pipeline against a brute-force version, stage by stage on the smallest tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from atelier.llm.queries import OP2_SQL, end_id, tokenizer_file  # noqa: E402
from tests.llm.test_operators import brute_quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_near(rows, similarity=0.8):
    """Smallest id of each document's class: all pairs of sets of five-word shingles are compared."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both and both >= similarity * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def brute(docs, items):
    """Ids and token CRCs that run() should give; so few labels certify no cutoff, so only base rules reject."""
    kept = []
    for d, text, source in docs:
        m = brute_quality(text)
        if m[0] >= 50 and 100 * m[4] <= 50 * m[0]:
            kept.append((d, text, source))
    first = brute_near([(d, t) for d, t, _ in kept])
    kept = [r for r in kept if first[r[0]] == r[0]]
    windows = set()
    for text in items:
        w = words(text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    kept = [r for r in kept if not any(tuple(w[i : i + n]) in windows for w in [words(r[1])] for n in sizes for i in range(len(w) - n + 1))]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(kept, columns=["doc_id", "text", "source"]))
    copies = {d: taken // size for d, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({OP2_SQL})").fetchall()}
    from tokenizers import Tokenizer

    library, out, start = Tokenizer.from_file(tokenizer_file()), [], 0
    for d, text, _ in sorted(kept):
        ids = library.encode(text, add_special_tokens=False).ids + [end_id()]
        for _ in range(copies[d]):
            out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            start += len(ids)
    return out


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = brute(docs, items)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected and max(Counter(d for d, *_ in got).values()) == 2


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(60), SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
