"""The pipeline's near-dedup stage against a brute-force comparison of all pairs of shingle sets."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from atelier.llm import nearcopies  # noqa: E402
from tests.llm.test_pipeline import brute_near  # noqa: E402


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(r, words, edits):
    out = list(words)
    for at in r.sample(range(len(out)), edits):
        out[at] = f"e{r.randrange(10**9)}"
    return out


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(5)
    rows, likeness = [], {}
    for i in range(150):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        copy = edited(r, base, r.choice([1, 2, 3, 4, 5, 9, 12]))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        likeness[2 * i + 1] = jaccard(grams(rows[-2][1]), grams(rows[-1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert set(range(0, 300, 2)) <= kept
    assert all(d in kept for d, s in likeness.items() if s < 0.8)
    near = [d for d, s in likeness.items() if s >= 0.84]
    assert len(near) > 60 and sum(d not in kept for d in near) >= 0.95 * len(near)


def test_one_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(edited(r, base, 2))) for i in range(400)], "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def test_texts_without_words_and_short_texts(spark):
    rows = [(1, None), (2, " \t"), (3, "a b"), (4, "A b"), (5, "a b c"), (None, "a b"), (7, "x " * 40), (7, "x " * 40)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((x.doc_id for x in out), key=str) == [1, 3, 5, 7, None]


def test_rows_that_share_a_doc_id_are_compared_by_their_own_texts(spark):
    r = random.Random(7)
    one, two = ([f"w{r.randrange(5000)}" for _ in range(300)] for _ in range(2))
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, " ".join(edited(r, two, 2))), (None, " ".join(edited(r, one, 1)))]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((x.doc_id for x in out), key=str) == [5, None]


def templated(seed, groups, common=300, of_group=30, own=10, copies=2):
    """Texts made from one template, whose groups are just below 0.8 to each other and copies of a group far above."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**9)}"
    base, rows = [word() for _ in range(common)], []
    for _ in range(groups):
        group = [word() for _ in range(of_group)]
        rows += [(len(rows) + k, " ".join(base + group + [word() for _ in range(own)])) for k in range(copies)]
    return rows


def classes(spark, rows):
    df = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    return {x.doc_id: x.component_id for x in df.collect()}


def test_all_copies_are_found_in_texts_of_one_template(spark):
    rows = templated(8, 300)
    assert classes(spark, rows) == brute_near(rows) and len(set(brute_near(rows).values())) == 300


def test_members_of_a_crowd_make_no_pairs_among_themselves(spark):
    """They are compared in blocks; met in small buckets, they made some hundred pairs a text beside."""
    r = random.Random(12)
    base, other = ([f"w{r.randrange(5000)}" for _ in range(300)] for _ in range(2))
    rows = [(i, " ".join(edited(r, base, 6))) for i in range(120)] + [(200, " ".join(other)), (201, " ".join(edited(r, other, 2)))]
    printed = nearcopies._printed(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {x.set_id: x.doc_id for x in printed.select("set_id", "doc_id").collect()}
    pairs, crowd = nearcopies.candidates(printed)
    members = {of[x.set_id] for x in crowd.collect()}
    met = [tuple(sorted((of[x.a], of[x.b]))) for x in pairs.collect()]
    assert len(members) > 60 and not members & {200, 201} and (200, 201) in met and len(set(met)) == len(met)
    assert not any(a in members and b in members for a, b in met)
    found = nearcopies._buckets(spark.createDataFrame([(v, b) for v, n in ((1, 1), (2, 2), (3, 8), (4, 9), (5, 40)) for b in range(100 * v, 100 * v + n)], "variant long, b long"))
    assert {(x.b // 100, x.crowded) for x in found.collect()} == {(2, False), (3, False), (4, True), (5, True)} and found.count() == 2 + 8 + 9 + 40
    assert all(len(x.before) + len(x.after) == 7 for x in found.where("b BETWEEN 300 AND 399").collect())


def test_strangers_do_not_meet_by_chance(spark, monkeypatch):
    """Bits of a fingerprint alone let them, with the square of their number: some 36 pairs of 2,000 texts."""
    monkeypatch.setattr(nearcopies, "MOST_BITS", 10_000)
    r = random.Random(13)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(2000)]
    rows += [(2000 + i, " ".join(edited(r, t.split(), 1))) for i, t in rows[:50]]
    printed = nearcopies._printed(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {x.set_id: x.doc_id for x in printed.select("set_id", "doc_id").collect()}
    pairs, crowd = nearcopies.candidates(printed)
    met = {tuple(sorted((of[x.a], of[x.b]))) for x in pairs.collect()}
    assert met <= {(i, 2000 + i) for i in range(50)} and len(met) >= 40 and crowd.isEmpty()


def test_crowds_of_any_shape_lose_no_link(spark, monkeypatch):
    """Chains, texts of several lengths and templates within templates, cut into many small blocks."""
    monkeypatch.setattr(nearcopies, "BLOCK", 1500)
    monkeypatch.setattr(nearcopies, "COLUMNS", 50)
    r = random.Random(11)
    rows = templated(9, 25, common=60, of_group=12, own=2)
    for k in range(12):
        base = [f"c{r.randrange(10**9)}" for _ in range(r.choice([30, 40, 80]))]
        for _ in range(6):
            base = edited(r, base, r.choice([1, 1, 2])) + ([f"e{k}"] if r.random() < 0.3 else [])
            rows.append((len(rows), " ".join(base)))
    for _ in range(40):
        rows.append((len(rows), " ".join(edited(r, rows[0][1].split(), r.randrange(0, 3)))))
    expected = brute_near(rows)
    sets = spark.createDataFrame([(d, sorted({hash(g) for g in grams(t)})) for d, t in rows], "set_id long, hashes array<long>")
    links = {(x.a, x.b) for x in nearcopies.crowded(sets).collect()}
    root = {d: d for d, _ in rows}
    for _ in range(len(rows)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == expected and 20 < len(set(expected.values())) < len(rows) - 60
