"""Media columns: ISO base media containers, written and walked box by box.

The reader never decodes a payload: it follows the nested boxes to the sample tables (stts, stsz or stz2, stsc, stco or
co64, stss) and stores codec, duration and the times and byte ranges of the keyframes. MEDIA's columns tell of the first
track, ``track_columns`` of each. Nothing is allocated before the bytes that it describes are known to be there, and boxes
are walked without recursion, so hostile counts and nestings end in an error like any other. The writer stores bytes losslessly as 8-bit unsigned PCM ('raw '), a sample of BLOCK bytes
each, so that any binary column can be kept in a container.

Null content counts as empty. Empty content still gets one block of zeros. Content that is no container, or a cut one,
yields nulls and the reason in ``error``; so do fragmented files, whose samples lie in no table of the movie box. Equal content gives equal bytes. Extra columns pass through unchanged; one with
the name of an output column is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_rows

BLOCK = 64  # bytes in a sample
KEYFRAME_EVERY = 16  # samples
CHUNK_SAMPLES = 64
TIMESCALE = 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}

RANGE = T.StructType([T.StructField("sample", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("time", T.LongType())])
MEDIA = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(RANGE)),
    T.StructField("error", T.StringType()),
])
TRACKS = T.StructType([T.StructField("tracks", T.ArrayType(MEDIA)), T.StructField("error", T.StringType())])


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def payload_of(content: bytes | None) -> bytes:
    content = content or b""
    return content + bytes(-len(content) % BLOCK or (0 if content else BLOCK))


def write_container(payload: bytes) -> bytes:
    """One audio track whose samples are the blocks of ``payload``, its length a positive multiple of BLOCK."""
    n = len(payload) // BLOCK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    brand = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    starts = range(0, n, CHUNK_SAMPLES)
    keys = range(1, n + 1, KEYFRAME_EVERY)
    runs = [(1, min(n, CHUNK_SAMPLES), 1)] + ([(len(starts), n % CHUNK_SAMPLES, 1)] if n > CHUNK_SAMPLES and n % CHUNK_SAMPLES else [])
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))

    def movie(base: int) -> bytes:
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, BLOCK)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", BLOCK, n)),
            full_box(b"co64", struct.pack(f">I{len(starts)}Q", len(starts), *(base + s * BLOCK for s in starts))),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, n * BLOCK, 0x55C4, 0), version=1),
            full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
        )
        head = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * BLOCK), bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        whole = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, n * BLOCK, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", whole, box(b"trak", head, media))

    base = len(brand) + len(movie(0)) + 8 + 8 * (len(payload) + 8 >= 1 << 32)
    return brand + movie(base) + box(b"mdat", payload)


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the body of each box between ``start`` and ``end``."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind.decode('latin-1')!r} at {start} has {size} bytes")
        yield kind, start + head, start + size
        start += size


def boxes(data: memoryview, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """Begin and end of the first body of each kind in a track, in the order of the file."""
    found: dict[bytes, tuple[int, int]] = {}
    open_boxes = [walk(data, start, end)]
    while open_boxes:
        inner = next(open_boxes[-1], None)
        if inner is None:
            open_boxes.pop()
        elif inner[0] in CONTAINERS:
            open_boxes.append(walk(data, *inner[1:]))
        else:
            found.setdefault(inner[0], inner[1:])
    return found


class Table:
    """The numbers of a full box, which must lie within it."""

    def __init__(self, data: memoryview, body: tuple[int, int]):
        self.data, (self.at, self.end) = data[body[0] : body[1]], (4, body[1] - body[0])  # behind version and flags
        self.version = self.data[0] if self.end else 0

    def numbers(self, count: int, kind: str = ">u4") -> np.ndarray:
        size = count * np.dtype(kind).itemsize
        if self.at + size > self.end:
            raise ValueError(f"{count} numbers in {self.end - self.at} bytes")
        found = np.frombuffer(self.data, kind, count, self.at).astype(np.int64)
        self.at += size
        return found

    def word(self) -> int:
        return int(self.numbers(1)[0])


def sample_sizes(view: memoryview, at: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stz2" in at:
        table = Table(view, at[b"stz2"])
        width, n = table.word() & 0xFF, table.word()
        if width == 4:
            both = table.numbers(-(-n // 2), "u1")
            return np.stack([both >> 4, both & 15], 1).ravel()[:n]
        if width not in (8, 16):
            raise ValueError(f"sample sizes of {width} bits")
        return table.numbers(n, ">u1" if width == 8 else ">u2")
    table = Table(view, at[b"stsz"])
    fixed, n = table.word(), table.word()
    if fixed and n * fixed > len(view):
        raise ValueError("samples lie beyond the end")
    return np.full(n, fixed, np.int64) if fixed else table.numbers(n)


def sample_table(view: memoryview, track: tuple[int, int]) -> dict:
    """Codec, timing and each sample's place of a track."""
    at = boxes(view, *track)
    head = Table(view, at[b"mdhd"])
    head.numbers(16 if head.version else 8, "u1")
    timescale, duration = head.word(), int(head.numbers(1, ">u8" if head.version else ">u4")[0])
    sizes = sample_sizes(view, at)
    n = len(sizes)
    table = Table(view, at[b"co64"] if b"co64" in at else at[b"stco"])
    chunks = table.numbers(table.word(), ">u8" if b"co64" in at else ">u4")
    table = Table(view, at[b"stsc"])
    runs = table.numbers(3 * table.word()).reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if len(per_chunk) != len(chunks):
        raise ValueError("runs of chunks don't fit the chunks")
    chunk = np.repeat(np.arange(len(chunks)), np.diff(np.minimum(np.cumsum(per_chunk), n), prepend=0))
    if len(chunk) < n:
        raise ValueError(f"{n} samples, but chunks for {len(chunk)}")
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.searchsorted(chunk, chunk)
    starts = chunks[chunk] + before - before[first]
    if n and ((starts + sizes).max() > len(view) or starts.min() < 0):
        raise ValueError("samples lie beyond the end")
    keys = np.arange(n)
    if b"stss" in at:
        table = Table(view, at[b"stss"])
        keys = table.numbers(table.word()) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("a keyframe is no sample")
    times = np.zeros(len(keys), np.int64)
    if b"stts" in at:
        table = Table(view, at[b"stts"])
        spans = table.numbers(2 * table.word()).reshape(-1, 2)
        ends, passed = np.cumsum(spans[:, 0]), np.cumsum(spans[:, 0] * spans[:, 1])
        if n != (ends[-1] if len(ends) else 0):
            raise ValueError("times of other samples")
        run = np.searchsorted(ends, keys, "right")
        times = passed[run] - (ends[run] - keys) * spans[run, 1]
        duration = int(passed[-1]) if n else duration
    table = Table(view, at[b"stsd"])
    table.numbers(8, "u1")
    codec = bytes(table.numbers(4, "u1").tolist()).decode("latin-1")
    return {"codec": codec, "timescale": timescale, "duration": duration, "starts": starts, "sizes": sizes, "keys": keys, "times": times}


def tracks_of(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of the body of each track of the movie."""
    view = memoryview(data)
    kinds = {}
    for kind, *body in walk(view, 0, len(view)):
        kinds.setdefault(kind, body)
    if b"moov" not in kinds:
        raise ValueError("no moov box")
    if b"moof" in kinds:
        raise ValueError("fragmented: samples lie in moof boxes")
    found = [tuple(body) for kind, *body in walk(view, *kinds[b"moov"]) if kind == b"trak"]
    if not found:
        raise ValueError("no track")
    return found


REFUSALS = (ValueError, KeyError, IndexError, struct.error, OverflowError)


def described(data: bytes, track: tuple[int, int]) -> tuple:
    """What MEDIA holds of a track, without its payload."""
    try:
        t = sample_table(memoryview(data), track)
        keys = [(int(k) + 1, int(t["starts"][k]), int(t["sizes"][k]), int(at)) for k, at in zip(t["keys"], t["times"], strict=True)]
        return t["codec"], t["timescale"], t["duration"], len(t["sizes"]), [dict(zip(("sample", "start", "length", "time"), k, strict=True)) for k in keys], None
    except REFUSALS as e:
        return None, None, None, None, None, f"{type(e).__name__}: {e}"


def probe(data: bytes | None) -> tuple:
    """What MEDIA holds of a container's first track."""
    try:
        return described(data, tracks_of(data or b"")[0])
    except REFUSALS as e:
        return None, None, None, None, None, f"{type(e).__name__}: {e}"


def probe_tracks(data: bytes | None) -> tuple:
    """What MEDIA holds of each track, and why none could be read."""
    try:
        return [dict(zip(MEDIA.fieldNames(), described(data, t), strict=True)) for t in tracks_of(data or b"")], None
    except REFUSALS as e:
        return None, f"{type(e).__name__}: {e}"


def read_payload(data: bytes) -> bytes:
    """The bytes of the first track's samples in order; neighbours are read as one range."""
    t = sample_table(memoryview(data), tracks_of(data)[0])
    starts, sizes = t["starts"], t["sizes"]
    if not len(starts):
        return b""
    breaks = np.flatnonzero(starts[1:] != (starts + sizes)[:-1]) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(starts)]]) - 1
    return b"".join(data[int(starts[a]) : int(starts[b] + sizes[b])] for a, b in zip(first, last, strict=True))


def media_columns(df: DataFrame, content: str) -> DataFrame:
    """``df`` with the columns of MEDIA for the containers in the binary column ``content``."""
    return map_rows(df, content, MEDIA, lambda: probe)


def track_columns(df: DataFrame, content: str) -> DataFrame:
    """``df`` with ``tracks`` (MEDIA of each) and ``error`` for the containers in the binary column ``content``."""
    return map_rows(df, content, TRACKS, lambda: probe_tracks)


STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), *MEDIA.fields])


def store(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = write_container(payload_of(raw))
    return len(raw), media, read_payload(media), *probe(media)


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text in a container of its own (``media``), what reads back of it (``payload``), and MEDIA's columns."""
    return map_rows(df, text, STORED, lambda: store)


def digest(stored: DataFrame) -> DataFrame:
    """The digest columns of op10."""
    keys = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["start"], k["length"])), ",")
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("codec=%s;timescale=%d;duration=%d;samples=%d;keyframes=%d;ranges=%08x", F.trim("codec"), "timescale", "duration", "n_samples", F.size("keyframes"), F.crc32(keys.cast("binary"))).alias("feature"),
    )

