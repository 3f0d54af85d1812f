"""The token store's encoder against the library, text by text."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from atelier.llm import tokenstore  # noqa: E402

FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", "é", "ÿ", ".", ",", "\n", "\n", " ", "'s", "'", "12", "|", "<|endoftext|>", "Über", "x-y", "...", "!?", "\1", "\t", "#", "n't", "日"]


def encoded(encoder, texts):
    ids, n = encoder(texts)
    ends = [sum(n[: k + 1]) for k in range(len(n))]
    assert len(ids) == sum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def test_ids_are_the_librarys():
    r = random.Random(5)
    blanks = ["a\n\n", "\n\n", "a\n\n\nb", "a\n\n\n\nb c", "a\n\nb", "a ", " a", "\n", " ", "", None]  # line ends that end a text are one piece
    library, encoder = Tokenizer.from_file(FILE), tokenstore.Encoder(FILE, 0)
    for texts in [blanks, *(["".join(r.choices(PIECES, k=r.randint(0, 14))) for _ in range(300)] for _ in range(10)), []]:
        assert encoded(encoder, texts) == [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_words_are_looked_up_once_a_part():
    class Counted(dict):
        asked = 0

        def get(self, word):
            Counted.asked += 1
            return super().get(word)

    encoder = tokenstore.Encoder(FILE, 0)
    encoder.known = Counted(encoder.known)
    text = "the cat sat, and the dog. " * 500 + "end"
    encoded(encoder, [text] * 20)
    assert 0 < Counted.asked < 20
