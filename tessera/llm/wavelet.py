"""Token ids as files: a wavelet matrix for each shard of documents, with rank and select over compressed bit-planes.

A wavelet matrix holds a bit-plane for each bit of an id, from the highest. After each plane the ids with a 0 there move
before those with a 1, each in their order. So an id's place in the next plane is the number of zeros (or all zeros and
the number of ones) before it: one rank for each plane gives the id at a place, or how often an id occurs before a place,
and one select for each plane, upwards, gives the place of its n-th occurrence.

A file holds: a header (MAGIC and counts), the documents (key, whether it is null, end of its ids), and for each plane
blocks of BLOCK_BITS bits, compressed each by itself, with the number of ones before each block. ``Shard`` reads a
block when it is asked for it, so a lookup decompresses a few blocks and not the file; ``ids`` undoes whole planes.

``store`` deals documents by range of their key, rows with equal keys included (a row number breaks ties), so that no key's
rows meet in one task; a task cuts its sorted documents into shards of about SHARD_IDS ids and writes each under a
temporary name first, so a task that runs again, or twice, leaves the same files. Only a row for each shard is kept besides.

Null texts count as empty: the end id alone. Null keys come first. Rows with an equal key stand one after another, each as
a document. Long texts are encoded whole; a document that is longer than a shard has one of its own. Equal texts have
equal ids. Empty tables give no file and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import PLAIN, byte_characters, json_tokenizer
from tessera.llm.common import checkpoint_folder, map_rows, written

MAGIC = b"WVM1"
#: magic, ids, documents, planes, bits of a block, bytes of the compressed documents
HEADER = struct.Struct("<4sQQIIQ")
BLOCK_BITS = 1 << 18
SHARD_IDS = 1 << 22
#: Rows of a range of keys, about; a task streams them and cuts them into shards.
RANGE_ROWS = 100_000
END = 2
#: The tokenizer's pieces of lower-cased text of PLAIN characters.
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\t-\r ]|_)+")
#: Words whose ids a task keeps, in a generation.
CACHE = 400_000
#: Bits set in each byte, and before each bit of a byte, from the highest.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


# Encoding.


def id_type(ids: int) -> str:
    """What holds so many ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


class Known(dict):
    """Ids of words; unknown ones are worked out. Two generations: once CACHE words are in, only those in use stay."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self[word] = self.old.get(word) or self.work(word)
        return found


class Words:
    """Ids of texts by a tokenizer of lower-cased words, word by word, with a bounded cache of words.

    The tokenizer never joins across white space. Texts of PLAIN characters alone, which its normalizer leaves as they are
    but for case, are cut into its pieces here, and its model gets each; words of other texts go through the whole tokenizer.
    Those are split at \\x20 and \\x09-\\x0D alone, since the tokenizer itself splits them further.
    """

    def __init__(self, path: str, end: int | None):
        self.tokenizer = json_tokenizer(path)
        self.model, self.spelt = self.tokenizer.model.tokenize, dict(enumerate(byte_characters()))
        self.type = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.type == "<u2" else "I"
        self.end = b"" if end is None else np.array(end, self.type).tobytes()
        self.known = Known(self.word)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, by the model, which takes characters that stand for bytes."""
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spelt)
        return array(self.code, [t.id for t in self.model(spelt)]).tobytes()

    def word(self, word: str) -> bytes:
        if word.isalpha() or len(pieces := PIECES.findall(word)) == 1:
            return self.piece(word)
        return b"".join([self.known[p] for p in pieces])

    def plain(self, texts: list[str]) -> list[bytes]:
        """Texts of PLAIN characters: each distinct word of all is looked up once."""
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.string()))
        coded = split.flatten().dictionary_encode()
        each = pa.array([self.known[w] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary())
        _, ends, joined = each.take(coded.indices).buffers()
        bounds = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist() if len(coded) else [0] * (len(texts) + 1)
        ids = memoryview(joined or b"")
        return [bytes(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def other(self, text: str) -> bytes:
        own = self.tokenizer.encode_batch_fast([w.decode() for w in text.encode().split()], add_special_tokens=False)
        return b"".join([array(self.code, e.ids).tobytes() for e in own])

    def many(self, texts: list[str | None]) -> list[tuple[bytes]]:
        plain = [i for i, t in enumerate(texts) if t and not PLAIN.search(t)]
        ids = dict(zip(plain, self.plain([texts[i] for i in plain]), strict=True))
        return [((ids[i] if i in ids else self.other(t or "")) + self.end,) for i, t in enumerate(texts)]


@lru_cache(2)
def words(path: str, end: int | None) -> Words:
    return Words(path, end)


def encode(df: DataFrame, path: str, text: str = "text", end: int | None = END) -> DataFrame:
    """``df`` with ``ids``: the bytes of little-endian integers of ``id_type``, ``end`` behind each text's own."""
    return map_rows(df, text, T.StructType([T.StructField("ids", T.BinaryType())]), lambda: words(path, end))


# The file.


def plane_bytes(bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Compressed blocks of a plane after their index: for each its end among the bytes and the ones before it."""
    packed, step = np.packbits(bits), BLOCK_BITS // 8
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks = [squeeze(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
    ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
    ends = np.cumsum([0, *map(len, blocks)]).astype("<i8")
    return struct.pack("<I", len(blocks)) + ends.tobytes() + before.tobytes() + b"".join(blocks), before


def file_bytes(ids: np.ndarray, keys: list[int | None], lengths: list[int]) -> bytes:
    """One shard: the ids of its documents, one after another."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    seq = ids.astype(id_type(1 << planes))
    made = []
    for k in reversed(range(planes)):
        bits = (seq >> k & 1).astype(bool)
        made.append(plane_bytes(bits)[0])
        seq = np.concatenate([seq[~bits], seq[bits]])
    table = np.array([0 if x is None else x for x in keys], "<i8").tobytes() + np.array([x is None for x in keys], np.uint8).tobytes() + np.cumsum(lengths).astype("<i8").tobytes()
    documents = zstandard.ZstdCompressor(level=1).compress(table)
    index = np.cumsum([0, *map(len, made)]).astype("<i8").tobytes()
    return HEADER.pack(MAGIC, len(ids), len(keys), planes, BLOCK_BITS, len(documents)) + documents + index + b"".join(made)


class Plane:
    def __init__(self, content: memoryview, block_bits: int, n: int):
        (blocks,) = struct.unpack_from("<I", content)
        self.n, self.block_bits = n, block_bits
        self.ends = np.frombuffer(content, "<i8", blocks + 1, 4)
        self.before = np.frombuffer(content, "<i8", blocks + 1, 4 + 8 * (blocks + 1))
        self.content, self.at = content, 4 + 16 * (blocks + 1)
        self.zeros = n - int(self.before[-1])
        self.block = lru_cache(8)(self.read)

    def read(self, i: int) -> np.ndarray:
        """The bits of a block, as bytes."""
        raw = zstandard.ZstdDecompressor().decompress(bytes(self.content[self.at + self.ends[i] : self.at + self.ends[i + 1]]), max_output_size=self.block_bits // 8)
        return np.frombuffer(raw, np.uint8)

    def bit(self, i: int) -> int:
        block = self.block(i // self.block_bits)
        return block[i % self.block_bits // 8] >> 7 - i % 8 & 1

    def ones(self, i: int) -> int:
        """Ones before place i."""
        if i >= self.n:
            return int(self.before[-1])
        k, r = divmod(i, self.block_bits)
        block = self.block(k)
        part = int(block[r // 8]) >> 8 - r % 8 if r % 8 else 0
        return int(self.before[k] + ONES[block[: r // 8]].sum() + part.bit_count())

    def place(self, bit: int, nth: int) -> int:
        """Place of the nth (from 0) bit of this value."""
        before = self.before if bit else np.arange(len(self.before)) * self.block_bits - self.before
        k = int(np.searchsorted(before[:-1], nth, "right")) - 1
        bits = np.unpackbits(self.block(k))
        return k * self.block_bits + int(np.flatnonzero(bits == bit)[nth - int(before[k])])

    def whole(self) -> np.ndarray:
        return np.unpackbits(np.concatenate([self.read(i) for i in range(len(self.ends) - 1)] or [np.zeros(0, np.uint8)]), count=self.n).astype(bool)


class Shard:
    """Reads a file's bytes. Damaged or foreign files raise ValueError."""

    def __init__(self, content: bytes):
        if len(content) < HEADER.size or content[:4] != MAGIC:
            raise ValueError("not a file of token ids")
        view = memoryview(content)
        _, self.n, documents, planes, block_bits, size = HEADER.unpack_from(content)
        at = HEADER.size + size
        try:
            table = zstandard.ZstdDecompressor().decompress(bytes(view[HEADER.size : at]), max_output_size=17 * documents)
        except zstandard.ZstdError as e:
            raise ValueError("the file is cut") from e
        if len(table) != 17 * documents or len(content) < at + 8 * (planes + 1):
            raise ValueError("the file is cut")
        keys, absent = np.frombuffer(table, "<i8", documents), np.frombuffer(table, np.uint8, documents, 8 * documents)
        self.keys = [None if a else int(k) for k, a in zip(keys, absent, strict=True)]
        self.ends = np.frombuffer(table, "<i8", documents, 9 * documents)
        index = np.frombuffer(content, "<i8", planes + 1, at)
        body = at + 8 * (planes + 1)
        if len(content) != body + index[-1]:
            raise ValueError("the file is cut")
        self.planes = [Plane(view[body + a : body + b], block_bits, self.n) for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True)]

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        found = 0
        for p in self.planes:
            bit, ones = p.bit(i), p.ones(i)
            found, i = found << 1 | int(bit), p.zeros + ones if bit else i - ones
        return found

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a stretch of places."""
        a, b = self.span(token, start, self.n if end is None else end)
        return b - a

    def span(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences within a stretch stand below the last plane."""
        if token < 0 or token >> len(self.planes) or a >= b:
            return 0, 0
        for k, p in enumerate(self.planes):
            x, y = p.ones(a), p.ones(b)
            a, b = (p.zeros + x, p.zeros + y) if token >> len(self.planes) - 1 - k & 1 else (a - x, b - y)
            if a >= b:
                return 0, 0
        return a, b

    def select(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id."""
        a, b = self.span(token, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        at = a + nth
        for k, p in enumerate(reversed(self.planes)):
            bit = token >> k & 1
            at = p.place(bit, at - p.zeros if bit else at)
        return at

    def document(self, place: int) -> int:
        """Number (in the file) of the document that a place belongs to."""
        return int(np.searchsorted(self.ends, place, "right"))

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest."""
        kind = np.dtype(id_type(1 << len(self.planes))).type
        seq = np.zeros(self.n, kind)
        for k, p in enumerate(reversed(self.planes)):
            bits = p.whole()
            out = np.empty(self.n, kind)
            out[~bits], out[bits] = seq[: p.zeros], seq[p.zeros :] | kind(1 << k)
            seq = out
        return seq.astype("<u4")


# Shards.

SHARDS = "part long, nth long, first long, n_documents long, n_tokens long, name string"


def write_file(folder: str, name: str, content: bytes) -> None:
    """Under a temporary name, then moved: no reader sees a part of it, and a second writer leaves the same."""
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(own := f"{at}/_{uuid4().hex}") as out:
        out.write(content)
    store.move(own, f"{at}/{name}")


def as_uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def store(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end: int | None = END) -> DataFrame:
    """Write the ids of all texts, in the order of ``key``, as files below ``folder``; a row for each file, with SHARDS and start.

    ``first`` is the number of ids before the file in its part (a range of keys), ``start`` in all files before it.
    """
    target, spark, kind = as_uri(folder), df.sparkSession, np.dtype(words(path, end).type)
    narrow = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = written(encode(narrow, path, "text", end).select("key", "ids", F.monotonically_increasing_id().alias("nth")))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], SHARDS + ", start long")
    parts = max(-(-n // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 1000)))
    in_order = rows.repartitionByRange(parts, "key", "nth").sortWithinPartitions("key", "nth").select("key", "ids", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, total, first, nth, part = [], [], 0, 0, 0, 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            name = f"{part:06d}-{nth:06d}.wvm"
            write_file(target, name, file_bytes(ids, keys, [len(x) // kind.itemsize for x in held]))
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "first": [first], "n_documents": [len(keys)], "n_tokens": [len(ids)], "name": [name]})

        for batch in batches:
            for key, ids, part in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "part")), strict=True):  # noqa: B007
                if keys and total + len(ids) // kind.itemsize > SHARD_IDS:
                    yield shard()
                    nth, first = nth + 1, first + total
                    keys, held, total = [], [], 0
                keys.append(key)
                held.append(ids)
                total += len(ids) // kind.itemsize
        if keys:
            yield shard()

    files = written(in_order.mapInArrow(run, SHARDS))
    # One row for each range of keys; shards find theirs by its number.
    before = files.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    return files.join(before, "part").select(*files.columns, (F.col("base") + F.col("first")).alias("start"))


DOCUMENTS = "name string, key long, at long, n_tokens long, ids_crc32 long, ids array<int>"


def read(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """name (of the file), key, at (place of the first id in the file), n_tokens, ids_crc32 and, if kept, ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                ids, ends = shard.ids(), shard.ends.tolist()
                starts = [0, *ends[:-1]]
                each = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                made = {"name": [path.rsplit("/", 1)[-1]] * len(ends), "key": shard.keys, "at": starts, "n_tokens": [len(x) for x in each], "ids_crc32": [zlib.crc32(x) for x in each]}
                kept = pa.array([x.view("<i4") for x in each] if keep_ids else [None] * len(each), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(made["name"], pa.string()), *[pa.array(made[c], pa.int64()) for c in ("key", "at", "n_tokens", "ids_crc32")], kept], names=[*made, "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    found = files.mapInArrow(run, DOCUMENTS)
    return found if keep_ids else found.drop("ids")


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """name, token, key, n: documents with these ids, found by rank and select in the compressed files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard, rows = Shard(content.as_py()), []
                for token in tokens:
                    left, at, total = 0, 0, shard.count(token)
                    while left < total:
                        document = shard.document(shard.select(token, left))
                        at = shard.count(token, 0, int(shard.ends[document]))
                        rows.append({"name": path.rsplit("/", 1)[-1], "token": token, "key": shard.keys[document], "n": at - left})
                        left = at
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("token", pa.int32()), ("key", pa.int64()), ("n", pa.int64())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    return files.mapInArrow(run, "name string, token int, key long, n long")


def store_and_read(df: DataFrame, path: str) -> DataFrame:
    """The columns of op12: the files are written to the shared folder, then read back."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/tokens-{uuid4().hex}"
    files = store(df.select("doc_id", "text"), path, folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read(spark, folder).join(files.select("name", F.col("start").alias("base")), "name")
    return found.select(F.col("key").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
