"""Packing: every id in exactly one piece, sequences without gaps, little padding."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tests.llm.helpers import ODD, documents, empty, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def check(rows, texts_by_id, least_fill):
    """The contract's rules, by brute force. Documents are told apart by their ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts_by_id)
    for doc, pieces in by_doc.items():
        ids = np.array(TOKENIZER.encode(texts_by_id[doc] or "", add_special_tokens=False).ids + [packing.END], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in rows) >= least_fill * packing.CAPACITY * len(by_sequence)


def test_pieces_and_sequences(spark):
    rng = random.Random(5)
    texts = [*ODD, *[prose(rng, rng.choice([0, 1, 5, 40, 400, 3000])) for _ in range(300)]]
    rows = packing.pack(documents(spark, texts), PATH).collect()
    check(rows, dict(enumerate(texts)), 0.97)


def test_many_equal_lengths_fill_bins(spark):
    """One length holds nearly all documents; shards and their shifts still give full bins."""
    texts = ["word " * 99] * 900 + ["x"] * 40
    rows = packing.pack(documents(spark, texts), PATH).collect()
    check(rows, dict(enumerate(texts)), 0.9)


def test_one_length_in_many_shards(spark, monkeypatch):
    """However many shards a length is dealt to, its bins stay full and its ranks have no gap."""
    monkeypatch.setattr(packing, "SHARD", 7)
    texts = ["word " * 99] * 700 + ["a", "b c"] * 20
    rows = packing.pack(documents(spark, texts), PATH).collect()
    check(rows, dict(enumerate(texts)), 0.9)


@pytest.mark.parametrize("total", [1, 2, 63, 64, 65, 1023, 1024, 1025, 2047, 2048, 2049, 5000, 1_000_003])
def test_lengths_of_pieces(total):
    lengths = list(packing.piece_lengths(total))
    assert sum(lengths) == total and min(lengths) >= 1
    assert all(n <= packing.TAIL or n == packing.CAPACITY // (packing.CAPACITY // n) for n in lengths)


def test_results_are_the_same_each_time(spark):
    docs = documents(spark, [prose(random.Random(i), i) for i in range(80)])
    order = ["doc_id", "start"]
    assert packing.pack(docs, PATH).orderBy(order).collect() == packing.pack(docs.repartition(5), PATH).orderBy(order).collect()


def test_edges(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
    only = packing.pack(documents(spark, [None]), PATH).collect()
    assert [(r["length"], r["offset"], r["doc_tokens"]) for r in only] == [(1, 0, 1)]
    twice = packing.pack(documents(spark, ["a b", "a b", "c"], ids=[7, 7, None]), PATH).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    clashing = documents(spark, ["a b c"]).withColumns({n: F.lit("own") for n in ("start", "ids", "piece", "pieces", "doc_tokens", "length")})
    row = packing.pieces_of(clashing, PATH, keep_ids=True).first()
    assert row["ids"] == TOKENIZER.encode("a b c").ids + [packing.END] and row["source"] == "src0"


def test_packing_keeps_more_matches():
    """Packing meets so many distinct matches that a generation of the usual size would lose those in use; ids are the same."""
    own = packing.Cutter(PATH, True)
    usual = bpe.Encoder(PATH)
    assert own.encoder.cache == packing.MATCHES > usual.cache
    texts = [f"word{i} x{i % 7}" for i in range(50)]
    assert [x.tolist() for x in own.encoder.many(texts)] == [x.tolist() for x in usual.many(texts)]


def test_new_words_are_encoded_as_one_text(monkeypatch):
    """Matches of a space and letters go through the tokenizer joined, the others by themselves; ids are the tokenizer's."""
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    own, given = bpe.Encoder(PATH, 5), []
    real = own.tokenizer

    class Seen:
        def encode_batch_fast(self, batch, **how):
            given.append(batch[0])
            return real.encode_batch_fast(batch, **how)

    own.tokenizer = Seen()
    texts = [*ODD, "plain words and über straße ǅ ƻ ǀǃ", "it's 12 <|endoftext|> x_y  two\n\nlines", " a b c d e f g h i j k", None, ""]
    for _ in range(2):
        for text, ids in zip(texts, own.many(texts), strict=True):
            assert ids.tolist() == TOKENIZER.encode(text or "", add_special_tokens=False).ids
    assert any(isinstance(x, str) for x in given) and any(isinstance(x, list) for x in given)
