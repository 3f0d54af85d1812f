"""Pseudonyms against a plain Python Feistel permutation with the same key, texts and all."""

from __future__ import annotations

import datetime
import hashlib
import random
import re

import pytest

pytest.importorskip("public_tokenizers")

from atelier.llm import pseudonyms  # noqa: E402

KEY = "k1"


def permuted(values, radices, tweak):
    half = len(values) // 2
    sides, mods = [list(values[:half]), list(values[half:])], [radices[:half], radices[half:]]
    for r in range(10):
        own, other = (0, 1) if r % 2 == 0 else (1, 0)
        said = "|".join([KEY, tweak, str(r), ",".join(map(str, sides[other]))])
        sides[own] = [(v + int(hashlib.sha256(f"{said}|{i}".encode()).hexdigest()[:12], 16)) % m for i, (v, m) in enumerate(zip(sides[own], mods[own], strict=True))]
    return sides[0] + sides[1]


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))


def refilled(s, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: str(next(it)), s)


def card(s):
    d = [int(c) for c in s if c.isdigit()]
    if luhn(d) % 10:
        return s
    body = permuted(d[:-1], [10] * (len(d) - 1), "card")
    return refilled(s, [*body, -luhn([*body, 0]) % 10])


def address(s):
    o = [int(x) for x in s.split(".")]
    if max(o) > 255:
        return s
    common = 1 <= o[0] <= 223
    base = 1 if common else o[0]
    new = permuted([o[0] - base, *o[1:]], [223 if common else 1, 256, 256, 256], "ip")
    return ".".join(map(str, [new[0] + base, *new[1:]]))


def security(s):
    a, g, n = map(int, s.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and n):
        return s
    x, y, z = permuted([a - 1 if a < 666 else a - 2, g - 1, n - 1], [898, 99, 9999], "ssn")
    return f"{x + 1 if x < 665 else x + 2:03d}-{y + 1:02d}-{z + 1:04d}"


def day(s):
    try:
        n = (datetime.date.fromisoformat(s) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return s
    if not 0 <= n < 250 * 292:
        return s
    a, b = permuted([n // 292, n % 292], [250, 292], "date")
    return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 292 + b)).isoformat()


def mail(s):
    local, domain = s.split("@")
    base = [97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else 48 if "0" <= c <= "9" else ord(c) for c in local]
    radix = [{97: 26, 65: 26, 48: 10}.get(b, 1) if c.isalnum() else 1 for b, c in zip(base, local, strict=True)]
    new = permuted([ord(c) - b for b, c in zip(base, local, strict=True)], radix, "email")
    return "".join(chr(b + v) for b, v in zip(base, new, strict=True)) + "@" + domain


def test_texts_against_plain_python(spark):
    r, rows = random.Random(4), []
    for i in range(120):
        body = [r.randrange(10) for _ in range(r.choice([12, 14, 15]))]
        number = "".join(map(str, [*body, (-luhn([*body, 0]) + (i % 4 == 0)) % 10]))
        ip = ".".join(str(r.randrange(300 if i % 5 == 0 else 256)) for _ in range(4))
        ssn = f"{r.choice([0, 1, 665, 666, 667, 899, 900, r.randrange(1000)]):03d}-{r.randrange(100):02d}-{r.choice([0, r.randrange(10000)]):04d}"
        date = f"{r.randrange(1880, 2110)}-{r.randrange(1, 14):02d}-{r.randrange(1, 32):02d}"
        email = "".join(r.choice("abZY09._%") for _ in range(r.randrange(1, 9))) + "x@mail.example.org"
        text, new = "N{}o. {} and, {} ({}) é {}; {} {}", [card(number), address(ip), security(ssn), day(date), mail(email)]
        rows.append((i, text.format("\n", number, ip, ssn, date, email, number), text.format("\n", *new, new[0])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, expected string")
    out = pseudonyms.pseudonymise(docs, KEY)
    assert [(x.doc_id, x.text) for x in out.collect() if x.text != x.expected] == []
    back = pseudonyms.pseudonymise(out.drop("n_replaced", "kinds"), KEY, back=True)
    assert {x.doc_id: x.text for x in back.collect()} == {i: t for i, t, _ in rows}
