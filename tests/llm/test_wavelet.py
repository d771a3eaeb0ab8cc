"""Token ids in files: exact round trips, and rank and select against plain lists."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import wavelet
from tests.llm.helpers import ODD, documents, empty, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, wavelet.END]


def brute(texts, ids=None):
    """Of unique keys."""
    made, start = [], 0
    for key, text in sorted(zip(range(len(texts)) if ids is None else ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0)):
        own = ids_of(text)
        made.append((key, start, len(own), zlib.crc32(np.array(own, "<u4"))))
        start += len(own)
    return made


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())


@pytest.mark.parametrize("limits", [(1 << 22, 100_000), (50, 7)])
def test_by_brute_force(spark, monkeypatch, limits):
    """With the usual sizes, and with files and ranges so small that most documents have a file of their own."""
    monkeypatch.setattr(wavelet, "SHARD_IDS", limits[0])
    monkeypatch.setattr(wavelet, "RANGE_ROWS", limits[1])
    rng = random.Random(4)
    texts = [*ODD, "A\x1cb\x85c d e", "ÀÉ é ́x ﬁ İSTANBUL", "it's I'LL 'T x'd", "<|startoftext|> x", *[prose(rng, rng.choice([0, 1, 5, 40, 400])) for _ in range(90)]]
    assert found(wavelet.store_and_read(documents(spark, texts).repartition(3), PATH)) == brute(texts)


LETTERS = st.characters(exclude_categories=["Cs"]) | st.characters(max_codepoint=0x250) | st.sampled_from(" '.,!sStTdDmM1_$\n\u0301")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=40), max_size=5))
def test_words_encode_as_whole_texts(texts):
    got = [np.frombuffer(r[0], "<u2").tolist() for r in wavelet.words(PATH, wavelet.END).many(texts)]
    assert got == [ids_of(t) for t in texts]


def test_all_plain_characters_alone_and_between_letters():
    """Each goes the same way through both."""
    own = wavelet.words(PATH, None)
    for c in map(chr, [*range(0x250), *range(0x2000, 0x20D0)]):
        texts = [c, f"a{c}b", f"A{c} {c}S", f"'{c}s", f"1{c}1"]
        assert [np.frombuffer(r[0], "<u2").tolist() for r in own.many(texts)] == [ids_of(t)[:-1] for t in texts], ascii(c)


def test_the_cache_forgets(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", 3)
    own = wavelet.Words(PATH, None)
    for text in ("a b c d e", "a b x", "e f g h", "c d a"):
        assert np.frombuffer(own.many([text])[0][0], "<u2").tolist() == ids_of(text)[:-1] and len(own.known) <= 3


def test_words_in_use_are_worked_out_once():
    own, asked = wavelet.Words(PATH, None), []
    own.known.work = lambda w: asked.append(w) or b"\0\0"
    texts = [" ".join(f"w{i}" for i in range(k, k + 10_000)) for k in range(0, 300_000, 10_000)]
    for _ in range(2):
        assert {len(ids) for text in texts for ids in own.many([text])[0]} == {20_000}
    assert len(asked) == len(set(asked)) == 300_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 5), max_size=300))
def test_rank_and_select(values):
    """Blocks of 64 bits, so that a plane has several."""
    usual, wavelet.BLOCK_BITS = wavelet.BLOCK_BITS, 64
    try:
        shard = wavelet.Shard(wavelet.file_bytes(np.array(values, np.uint32), [5, None], [len(values), 0]))
    finally:
        wavelet.BLOCK_BITS = usual
    assert shard.ids().tolist() == values == [shard.access(i) for i in range(len(values))]
    assert shard.keys == [5, None] and shard.ends.tolist() == [len(values)] * 2
    for token in {*values[:20], 1, 69_999, 1 << 20}:
        places = [i for i, v in enumerate(values) if v == token]
        assert [shard.select(token, k) for k in range(len(places))] == places
        for a, b in ((0, None), (len(values) // 3, len(values) // 2), (7, 3)):
            assert shard.count(token, a, b) == values[a:b].count(token)
        with pytest.raises(IndexError):
            shard.select(token, len(places))


def test_occurrences_and_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 300)
    rng = random.Random(8)
    texts = [prose(rng, 30) for _ in range(60)]
    files = wavelet.store(documents(spark, texts), PATH, str(tmp_path / "own"))
    assert files.count() > 3 and files.agg(F.sum("n_documents")).first()[0] == 60
    stored = {r["key"]: r["ids"] for r in wavelet.read(spark, str(tmp_path / "own"), keep_ids=True).collect()}
    assert stored == {i: ids_of(t) for i, t in enumerate(texts)}
    tokens = [ids_of("river")[0], ids_of("the")[0], 49_000]
    expected = Counter({(t, k): ids.count(t) for k, ids in stored.items() for t in tokens if t in ids})
    assert Counter({(r["token"], r["key"]): r["n"] for r in wavelet.occurrences(spark, str(tmp_path / "own"), tokens).collect()}) == expected


def test_few_blocks_are_read_for_a_lookup():
    """One block of each plane is decompressed for a place, however large the file."""
    rng = np.random.default_rng(1)
    shard = wavelet.Shard(wavelet.file_bytes(rng.integers(0, 49_408, 2_000_000), [0], [2_000_000]))
    shard.access(1_234_567)
    assert all(len(p.ends) - 1 == 8 for p in shard.planes) and sum(p.block.cache_info().misses for p in shard.planes) <= 16


def test_damaged_files():
    good = wavelet.file_bytes(np.arange(100), [1], [100])
    for bad in (b"", b"WVM1", b"x" * 200, good[:-1], good[:60], good + b"x"):
        with pytest.raises(ValueError):
            wavelet.Shard(bad)


def test_a_task_that_runs_again_leaves_the_same_files(spark, tmp_path):
    docs = documents(spark, [prose(random.Random(i), 20) for i in range(40)])
    for _ in range(2):
        wavelet.store(docs, PATH, str(tmp_path / "own"))
        names = {p.name: p.read_bytes() for p in Path(tmp_path / "own").glob("[!.]*")}
        assert all(n.endswith(".wvm") for n in names)
    assert wavelet.read(spark, str(tmp_path / "own")).count() == 40


def test_edges(spark):
    assert wavelet.store_and_read(empty(spark), PATH).count() == 0
    assert found(wavelet.store_and_read(documents(spark, [None]), PATH)) == [(0, 0, 1, zlib.crc32(np.array([2], "<u4")))]
    twice = wavelet.store_and_read(documents(spark, ["a b", "a b", "c", None], ids=[7, 7, None, None]), PATH).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in twice)[-1] == (6, 3) and sum(r["n_tokens"] for r in twice) == 9
    assert {r["start"] for r in twice if r["doc_id"] is None} == {0, 2} or {r["start"] for r in twice if r["doc_id"] is None} == {0, 1}
    clashing = documents(spark, ["a b c", "d"]).withColumns({n: F.lit("own") for n in ("key", "ids", "nth", "name", "part", "start", "n_tokens")})
    assert found(wavelet.store_and_read(clashing, PATH)) == brute(["a b c", "d"])
    long = ["word " * 400_000, "x"]
    assert found(wavelet.store_and_read(documents(spark, long), PATH)) == brute(long)
