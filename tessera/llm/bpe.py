"""Byte-level BPE over Arrow batches: encoding with offsets, and decoding through the reversed byte table.

Texts are split into the matches of the vocabulary's pattern; the tokenizers library encodes matches that a task has not
met lately (a bounded cache keeps the others' ids), so most of the work on a text is a split and a lookup for each match.

A null text counts as empty: no ids. Long texts are encoded whole. Invalid ids raise KeyError. Equal texts give equal
ids. Extra columns pass through; one with the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm.common import HELD, map_rows

#: Distinct matches in a generation of what a task keeps, and those that go through the tokenizer in one call.
CACHE = 250_000
AT_ONCE = 20_000
#: Characters that re and regex class alike; texts of these alone take the faster engine.
PLAIN = re.compile(r"[^\t-\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿]")
PLAIN_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\t-\r ]|_)+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PATTERN = regex.compile(public_tokenizers.PATTERN)
#: A match of a space and Latin letters: a row of such matches is cut into the same ones, by any engine.
WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ɏ]+")


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def matches(text: str) -> list[str]:
    return PATTERN.findall(text) if PLAIN.search(text) else PLAIN_PATTERN.findall(text)


def parts(found: list[str]) -> list[list[str]]:
    return [found[at : at + AT_ONCE] for at in range(0, len(found), AT_ONCE)]


def rank_tokenizer(path: str) -> Tokenizer:
    """A tokenizer that merges by the ranks of a .tiktoken file: every split of a token into two tokens is a merge."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    names = byte_characters()
    spelt = {token: "".join(names[b] for b in token) for token in ranks}
    merges = [(spelt[t[:i]], spelt[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={spelt[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def json_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class Encoder:
    """From texts to their ids as little-endian unsigned 32-bit integers.

    The ids of matches are kept in two generations: when the younger is full it becomes the older one, so that matches in
    use stay. Unknown matches go through the tokenizer together, as the words of one pre-split text, or as one text where
    it cuts that into the same matches; token lengths in bytes tell which ids belong to which match.
    """

    def __init__(self, path: str, cache: int | None = None):
        self.cache = cache or CACHE
        self.tokenizer = rank_tokenizer(path) if path.endswith(".tiktoken") else json_tokenizer(path)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: The bytes of each id; None where the vocabulary has a gap.
        self.tokens: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(t or b"") for t in self.tokens], np.int64)
        #: Whether the tokenizer itself cuts texts by the pattern.
        self.splits = not path.endswith(".tiktoken")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, found: set[str]) -> None:
        known = found & self.old.keys()
        self.young.update((m, self.old[m]) for m in known)
        words, others = [], []
        for match in found - known:
            (words if self.splits and WORD.fullmatch(match) else others).append(match)
        for part, joined in [*((x, True) for x in parts(words)), *((x, False) for x in parts(others))]:
            # The pattern cuts a row of words before each space again, which costs less than to hand over each by itself.
            given = "".join(part) if joined else part
            ids = np.array(self.tokenizer.encode_batch_fast([given], is_pretokenized=not joined, add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(m.encode()) for m in part])) + 4).tolist()
            raw = ids.tobytes()
            self.young.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [matches(t) if t else [] for t in texts]
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        if new := set().union(*split).difference(self.young):
            self.learn(new)
        return [np.frombuffer(b"".join(map(self.young.__getitem__, row)), "<u4") for row in split]

    def encode(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(4)
def encoder(path: str, cache: int | None = None) -> Encoder:
    return Encoder(path, cache)


class Decoder:
    """From ids to bytes: the vocabulary's characters are turned back into the bytes they stand for."""

    def __init__(self, path: str):
        self.tokens, self.lengths = encoder(path).tokens, encoder(path).lengths
        self.known = np.array([t is not None for t in self.tokens])

    def decode(self, ids: Iterable[int] | None) -> bytes:
        ids = np.asarray(ids if ids is not None else [], np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens) or not self.known[ids].all()):
            raise KeyError("an id is not in the vocabulary")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def pieces(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of each part of a sequence of ids; a character that is split between parts comes with the later one."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            yield held.decode(self.decode(part))
        if rest := held.decode(b"", final=True):
            yield rest


@lru_cache(4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def forget() -> None:
    encoder.cache_clear()
    decoder.cache_clear()


HELD[(__name__, "tessera.llm.packing")] = forget


def offsets(text: str, ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one behind its last; tokens that share a character both cover it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(decoder(path).lengths[ids])
    return character[ends - decoder(path).lengths[ids]], character[ends - 1] + 1


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
SPANS = T.StructType([*ENCODED.fields, T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
DECODED = T.StructType([T.StructField("decoded", T.BinaryType())])


class Rows:
    """Tuples of ENCODED or SPANS for texts."""

    def __init__(self, path: str, spans: bool):
        self.path, self.spans, self.encoder = path, spans, encoder(path)

    def many(self, texts: list[str | None]) -> list[tuple]:
        each = self.encoder.many(texts)
        if not self.spans:
            return [(ids.view(np.int32),) for ids in each]
        return [(ids.view(np.int32), *(x.astype(np.int32) for x in offsets(t or "", ids, self.path))) for t, ids in zip(texts, each, strict=True)]


def encode(df: DataFrame, path: str, text: str = "text", spans: bool = False) -> DataFrame:
    """``df`` with ``ids``, and with ``starts`` and ``ends`` (characters) if ``spans``."""
    return map_rows(df, text, SPANS if spans else ENCODED, lambda: Rows(path, spans))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that ``ids`` stand for."""
    return map_rows(df, ids, DECODED, lambda: lambda x: (decoder(path).decode(x),))


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """The columns of op1."""
    encoded = encode(df.select("doc_id", "text"), path).drop("text")
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
