"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe
from tests.llm.helpers import ODD, documents, empty, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    return len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())


def test_round_trip_as_the_library(spark, library):
    rng = random.Random(1)
    texts = [*ODD, *[prose(rng, rng.randint(0, 300)) for _ in range(60)], "same", "same"]
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(documents(spark, texts), RANKS).collect()}
    assert found == {i: expected(library, t) for i, t in enumerate(texts)}


def test_documents_of_the_smallest_table(library):
    encoder, decoder = bpe.encoder(RANKS), bpe.decoder(RANKS)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for text, ids in zip(texts, encoder.many(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


def test_both_engines_of_the_pattern_split_alike():
    rng = random.Random(2)
    alphabet = "abZ09 _'\t\n\r\x0b\x1c\x85 é²ªµ-.,!s't'll ‐€ɏʰ"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12)))
        assert bpe.matches(text) == bpe.PATTERN.findall(text), repr(text)


def test_json_vocabulary_agrees_with_its_library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rng = random.Random(3)
    for text in [*[t for t in ODD if t], *[prose(rng, 50) for _ in range(20)]]:
        assert bpe.encoder(JSON).encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_cache_keeps_ids_right(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    small, rng = bpe.Encoder(RANKS), random.Random(4)
    for _ in range(30):
        texts = [prose(rng, 12) for _ in range(4)]
        assert [x.tolist() for x in small.many(texts)] == [bpe.encoder(RANKS).encode(t).tolist() for t in texts]


def test_offsets_cover_the_text(spark):
    texts = ["héllo wörld 🙂 東京", "", None, "plain"]
    for row in bpe.encode(documents(spark, texts), RANKS, spans=True).collect():
        text, decoder = texts[row["doc_id"]] or "", bpe.decoder(RANKS)
        covered = 0
        for i, a, b in zip(row["ids"], row["starts"], row["ends"], strict=True):
            assert a <= covered <= b and decoder.decode([i]) in text[a:b].encode()
            covered = b
        assert covered == len(text)


def test_split_characters_come_with_the_later_part():
    ids = bpe.encoder(RANKS).encode("a 🙂🙃 b").tolist()
    pieces = list(bpe.decoder(RANKS).pieces([i] for i in ids))
    assert "".join(pieces) == "a 🙂🙃 b" and not any("�" in p for p in pieces)
    assert list(bpe.decoder(RANKS).pieces([ids[:2]]))[-1].endswith("�") or bpe.decoder(RANKS).decode(ids[:2]).decode()


def test_ids_outside_the_vocabulary_are_an_error():
    for bad in ([-1], [50_256], [1 << 40]):
        with pytest.raises(KeyError):
            bpe.decoder(RANKS).decode(bad)


def test_edges(spark):
    assert bpe.round_trip(empty(spark), RANKS).count() == 0
    clashing = documents(spark, ["a b"]).withColumn("ids", F.lit("own")).withColumn("decoded", F.lit(1)).withColumn("starts", F.lit(None))
    row = bpe.decode(bpe.encode(clashing, RANKS, spans=True), RANKS).first()
    assert bytes(row["decoded"]) == b"a b" and row["source"] == "src0"
    nulls = documents(spark, [None, "x"], ids=[None, None])
    assert sorted(r["n_tokens"] for r in bpe.round_trip(nulls, RANKS).collect()) == [0, 1]
