"""The path-template tree against its SQL, on hosts whose sections differ in their labels."""

from __future__ import annotations

import math
import random

import duckdb
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")

from atelier.llm import urlfilter  # noqa: E402
from atelier.llm.queries import OP7_SQL, URL_RULES  # noqa: E402


def site(seed=9):
    """Urls of three hosts, whether each is bad, and whether it has a label."""
    r, rows = random.Random(seed), []
    for k in range(16000):
        host = r.choice(["hot.example.org", "hot.example.org", "hot.example.org", "b.example.com", "small.net"])
        section = "casino" if k % 110 == 0 else r.choice(["news", "blog", f"user{r.randrange(3000)}x"])
        deep = "/".join(r.choice(["a", "b", f"id{r.randrange(100)}"]) for _ in range(r.randrange(4)))
        bad = r.random() < (0.97 if section == "casino" else 0.6 if "b/" in deep and host[0] == "b" else 0.1)
        rows.append((k, f"https://{host}/{section}/{deep}/{k}.html" if deep else f"https://{host}/{section}/{k}.html?x=1", bad, r.random() < 0.6))
    rows += [(90000, None, True, True), (90001, "no scheme/7", True, True), (90002, "http://Hot.Example.org", False, False), (90003, "x://h//a//" + "/".join("s" * 40) + "/8", False, True), (90004, "http://k.com/en/3", False, False)]
    return [*rows, rows[0]]


def test_tree_equals_its_sql(spark):
    rows = site()
    pages = spark.createDataFrame([(i, u) for i, u, *_ in rows], "page_id long, url string")
    labels = spark.createDataFrame(sorted({(i, bad) for i, _, bad, known in rows if known}), "url_key long, bad boolean")
    got = urlfilter.judge(pages, labels, URL_RULES).collect()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([(i, u) for i, u, *_ in rows], columns=["page_id", "url"]))
    con.register("labels", pd.DataFrame(sorted({(i, 1 - bad, 0) for i, _, bad, known in rows if known}), columns=["doc_id", "quality", "toxic"]))
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({OP7_SQL})").fetchall()
    key = lambda x: (x[0], repr(x))
    both = list(zip(sorted((tuple(r[c] for c in columns) for r in got), key=key), sorted(expected, key=key), strict=True))
    assert all(a[:6] == b[:6] and math.isclose(a[6], b[6], rel_tol=1e-12) for a, b in both)
    hot = {r.template for r in got if r.host == "hot.example.org" and r.verdict == "block"}
    assert hot and all(t.startswith("/casino") for t in hot)  # under 1 % of its host's urls, and apart for its labels
    assert all(r.verdict == "block" for r in got if r.host == "hot.example.org" and r.path.startswith("/casino/"))
    assert len({round(r.purity, 6) for r in got}) > 3
