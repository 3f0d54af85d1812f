"""Main text that an article shares with others of its host, and articles whose class sounds like boilerplate, stay."""

from __future__ import annotations

from atelier.llm import htmltext


def test_repeated_branches_and_class_words_leave_articles_whole(spark):
    page = "<body><div class='x7'>Same on every page</div><article class='post has-sidebar'><h2>Summary</h2><p>Text {0} is <em>very</em> own</p><p class='note'>Shared note</p><div class='share'>share</div></article></body>"
    plain = "<body><div class='y9'><p>Text {0} is <em>very</em> own</p></div></body>"
    rows = [(i, f"http://s.example.com/{i}", page.replace("{0}", str(i * 37))) for i in range(30)]
    rows += [(100 + i, f"http://p.example.com/{i}", plain.replace("{0}", str(i * 37))) for i in range(30)]
    rows += [(200, "http://m.example.com/", "<body><p>around</p><main class='content no-ads'>whole text</main></body>")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    expected = {i: f"Summary Text {i * 37} is very own Shared note" for i in range(30)}
    expected |= {100 + i: f"Text {i * 37} is very own" for i in range(30)} | {200: "whole text"}
    assert got == expected
