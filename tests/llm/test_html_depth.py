"""Digests of branches at any depth: equal exactly where the branch's texts are equal, and linear in the page."""

from __future__ import annotations

import random
from collections import defaultdict

from atelier.llm import htmltext


def made(rng: random.Random, path: tuple[str, ...], texts: dict[tuple[str, ...], list[str]], depth: int) -> str:
    """A well-formed branch; its texts are added to those of each path above them, where inline elements are no part of a path."""
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["text", "div", "section", "b"] if depth else ["text"])
        if kind == "text":
            # an empty comment keeps two texts in a row apart, as they are in the list
            word = rng.choice("xy")
            for n in range(1, len(path) + 1):
                texts[path[:n]].append(word)
            out.append(f"{word}<!---->")
        else:
            below = path if kind == "b" else (*path, kind)
            out.append(f"<{kind}>{made(rng, below, texts, depth - 1)}</{kind}>")
    return "".join(out)


def test_digests_tell_texts_apart_whatever_the_inline_markup():
    rng, seen, lists = random.Random(5), defaultdict(set), defaultdict(set)
    ids = {}
    for _ in range(600):
        texts = defaultdict(list)
        page = htmltext.Page(f"<div>{made(rng, ('div',), texts, 4)}</div>", nodes=True)
        assert len(page.content) - 1 == len(texts)
        for path, words in texts.items():
            node = 0
            for name in path:
                node = ids.setdefault((node, name), htmltext.xxhash.xxh64_intdigest(name, node))
            seen[node, page.content[node]].add(tuple(words))
            lists[node, tuple(words)].add(page.content[node])
    assert len(seen) > 200
    assert all(len(v) == 1 for v in seen.values()) and all(len(v) == 1 for v in lists.values())


def test_elements_below_any_depth_are_nodes():
    page = htmltext.Page("".join(f"<div>t{i}" for i in range(5000)), nodes=True)
    assert len(page.nodes()) == 5000 and len({n["content"] for n in page.nodes()}) == 5000
    assert page.text() == " ".join(f"t{i}" for i in range(5000))
