"""Small tables of documents that the tests share."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "a bb the of Tree house river stone ñandú über 東京 don't x-y 1.5 42 naïve the and".split()
#: Texts at the edges: null, empty, white space, no spaces, unusual characters, one very long.
ODD = [None, "", " ", "\n\n\n", "\t \v\f\r", "x", " ", "a b", "🙂🙂‍", "\u0000\u0001", "ab" * 5000, "line\r\nline\r\nline\r\n", "<|endoftext|>", "İıſK", "é" * 50]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def documents(spark, texts, ids=None, **more):
    """A table of documents with one text each."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
