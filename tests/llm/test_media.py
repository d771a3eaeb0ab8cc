"""Containers: exact round trips, and reading boxes of other writers."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import media
from tests.llm.helpers import ODD, documents, empty, prose


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_texts_come_back(spark):
    rng = random.Random(6)
    texts = [*ODD, *[prose(rng, rng.randint(0, 4000)) for _ in range(30)], "x" * 64, "x" * 65, "x" * 4096, "x" * 4097]
    stored = media.store_texts(documents(spark, texts))
    media_of = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in media.digest(stored).collect():
        own, box = payload(texts[r["doc_id"]]), media_of[r["doc_id"]]
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["payload_bytes"] == len(own)
        assert r["payload_sha256"] == hashlib.sha256(own).hexdigest() and r["tail_crc32"] == zlib.crc32(own[-64:])
        assert r["media_bytes"] == len(box) and r["media_sha256"] == hashlib.sha256(box).hexdigest()
        assert own in box and f"samples={len(own) // 64};" in r["feature"] and r["feature"].startswith("codec=raw;")


def test_equal_texts_have_equal_values(spark):
    rows = media.digest(media.store_texts(documents(spark, ["same", "same"]))).drop("doc_id").collect()
    assert rows[0] == rows[1]


def test_keyframes_point_at_samples():
    own = bytes(range(256)) * 40
    row = dict(zip(media.MEDIA.fieldNames(), media.probe(box := media.write_container(own)), strict=True))
    assert row["error"] is None and row["n_samples"] == len(own) // 64 and row["duration"] == len(own)
    for k in row["keyframes"]:
        at = (k["sample"] - 1) * 64
        assert box[k["start"] : k["start"] + k["length"]] == own[at : at + 64]


def other_writer(sizes, chunk_sizes, wide=False, with_keys=True):
    """A video track whose samples differ in size, with 32-bit offsets, media first, and chunks apart from each other."""
    samples = [bytes([i]) * n for i, n in enumerate(sizes)]
    data, starts, i = b"", [], 0
    for n in chunk_sizes:
        data += b"gap"
        starts.append(len(data))
        data += b"".join(samples[i : i + n])
        i += n
    head = media.box(b"ftyp", b"mp42", bytes(4))
    body = media.box(b"free", bytes(5)) + (struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) if wide else struct.pack(">I4s", len(data) + 8, b"mdat"))
    base = len(head) + len(body)
    runs = [(k + 1, n, 1) for k, n in enumerate(chunk_sizes)]
    parts = [
        media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))),
        media.full_box(b"stts", struct.pack(">III", 1, len(sizes), 40)),
        media.full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        media.full_box(b"stsz", struct.pack(">II", 0, len(sizes)), *(struct.pack(">I", n) for n in sizes)),
        media.full_box(b"stco", struct.pack(">I", len(starts)), *(struct.pack(">I", base + s) for s in starts)),
    ]
    if with_keys:
        parts.append(media.full_box(b"stss", struct.pack(">III", 2, 1, 3)))
    track = media.box(b"trak", media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIII", 0, 0, 600, 40 * len(sizes)), bytes(4)), media.box(b"minf", media.box(b"stbl", *parts))))
    return head + body + data + media.box(b"moov", track), b"".join(samples)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("with_keys", [False, True])
def test_containers_of_other_writers(wide, with_keys):
    box, samples = other_writer([5, 1, 9, 2, 2], [2, 1, 2], wide, with_keys)
    row = dict(zip(media.MEDIA.fieldNames(), media.probe(box), strict=True))
    assert (row["codec"], row["timescale"], row["duration"], row["n_samples"], row["error"]) == ("avc1", 600, 200, 5, None)
    assert [k["sample"] for k in row["keyframes"]] == ([1, 3] if with_keys else [1, 2, 3, 4, 5])
    assert all(box[k["start"] : k["start"] + k["length"]] == bytes([k["sample"] - 1]) * k["length"] for k in row["keyframes"])
    assert media.read_payload(box) == samples


def test_broken_containers_give_a_reason(spark):
    whole = media.write_container(payload("some text"))
    rows = [(i, x) for i, x in enumerate([None, b"", b"no container", whole[:-30], whole[:60], whole])]
    found = media.media_columns(spark.createDataFrame(rows, "id long, content binary").withColumn("codec", F.lit(3)), "content").collect()
    by = {r["id"]: r for r in found}
    assert all(by[i]["error"] and by[i]["codec"] is None for i in range(5)) and by[5]["codec"] == "raw "
    rng = random.Random(7)
    for _ in range(300):  # no cut or changed container may crash
        broken = bytearray(whole)
        broken[rng.randrange(len(broken))] = rng.randrange(256)
        assert len(media.probe(bytes(broken[: rng.randrange(len(broken) + 1)]))) == 6


def patched(box, kind, offset, value):
    """``box`` with a 32-bit number changed behind the kind of a box."""
    at = box.index(kind) + 4 + offset
    return box[:at] + struct.pack(">I", value) + box[at + 4 :]


def test_hostile_counts_and_nesting_end(spark):
    """Counts that nothing stands behind, numbers of no sample and thousands of nested boxes give a reason at once."""
    whole = media.write_container(payload("some text " * 400))
    nested = b""
    for _ in range(5000):
        nested = media.box(b"udta", nested)
    most = 0xFFFFFFFF
    hostile = [
        patched(whole, b"stsz", 8, most), patched(patched(whole, b"stsz", 4, 0), b"stsz", 8, most), patched(whole, b"stsc", 4, most),
        patched(whole, b"stsc", 12, most), patched(whole, b"co64", 4, most), patched(whole, b"stss", 4, most), patched(whole, b"stss", 8, 0),
        patched(whole, b"stss", 8, most), patched(whole, b"stts", 4, most), patched(whole, b"stts", 8, most),
        media.box(b"moov", media.box(b"trak", nested)), whole + media.box(b"moof", bytes(8)),
    ]
    rows = spark.createDataFrame(list(enumerate(hostile)), "id long, content binary")
    found = {r["id"]: r for r in media.media_columns(rows, "content").collect()}
    # A chunk that claims more samples than there are is read up to the last sample.
    assert [i for i, r in sorted(found.items()) if not r["error"]] == [3]
    assert all(media.probe_tracks(x)[1] or media.probe_tracks(x)[0] for x in hostile)


def test_every_track_and_times_of_keyframes(spark):
    a, samples = other_writer([5, 1, 9, 2, 2], [2, 1, 2])
    moov = a.index(b"moov") - 4
    two = a[:moov] + media.box(b"moov", a[moov + 8 :], a[moov + 8 :])
    row = media.track_columns(spark.createDataFrame([(1, two)], "id long, content binary"), "content").first()
    assert row["error"] is None and [t["codec"] for t in row["tracks"]] == ["avc1", "avc1"]
    assert [[(k["sample"], k["time"]) for k in t["keyframes"]] for t in row["tracks"]] == [[(1, 0), (3, 80)]] * 2


@pytest.mark.parametrize(("width", "sizes"), [(4, [5, 1, 9]), (8, [5, 200, 9]), (16, [5, 700, 9])])
def test_compact_sample_sizes(width, sizes):
    packed = b"".join(n.to_bytes(width // 8) for n in sizes) if width > 4 else bytes([sizes[0] << 4 | sizes[1], sizes[2] << 4])
    box = media.full_box(b"stz2", struct.pack(">II", width, 3), packed)
    assert media.sample_sizes(memoryview(box), {b"stz2": (8, len(box))}).tolist() == sizes


def test_edges(spark):
    assert media.digest(media.store_texts(empty(spark))).count() == 0
    both = media.digest(media.store_texts(documents(spark, [None, ""], ids=[None, None]).withColumn("payload", F.lit(1)))).collect()
    assert both[0] == both[1] and both[0]["payload_bytes"] == 64
