"""MPEG audio: whole queries against plain Python, tags that payloads hold, checksums of all layers."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexmill.llm import media, queries


def read_back(body: bytes) -> bytes:
    stream = media.encode(body)
    s = media.scan(stream)
    assert s["resyncs"] == 0 and s["table"]["frames"] == len(s["offsets"])
    return media.payload(stream, s["offsets"], s["ends"], s["tags"])


@pytest.mark.parametrize("word", [b"TAG", b"APETAGEX", b"ID3\x03\x00\x00\x00\x00\x00\x7f", b"\xff\xfb\x90\xc0", b"Xing\x00\x00\x00\x07"])
def test_payloads_of_tags(word):
    for n in range(0, 3001):
        body = (word * (n // len(word) + 1))[:n]
        assert read_back(body) == body


def test_tags_at_every_distance_from_the_end():
    for word in (b"TAG", b"APETAGEX" + bytes([208, 7, 0, 0]) + b"\xff" * 20, b"APETAGEX" + b"\0" * 24):
        for n in range(64, 1400, 3):
            body = bytearray(b"x" * n)
            for back in (32, 128, 160):
                if back <= n:
                    body[n - back : n - back + len(word)] = word
            assert read_back(bytes(body)) == bytes(body)
    assert read_back(b"AG" + b"TAG" * 21) == b"AG" + b"TAG" * 21
    text = ("The report says: " + "x" * 48 + "TAG lines follow here and go on for a while until the very end of this short example of a text, which has some more words.").encode()
    assert read_back(text) == text


def test_tags_behind_the_audio():
    stream = media.encode(b"payload" * 400)
    n = len(media.scan(stream)["offsets"])
    old = b"TAG" + b"title".ljust(125, b"\0")
    item = b"\x05\0\0\0\0\0\0\0Title\0music"
    ape = item + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    for tail, names in ((old, {"TAG"}), (ape, {"APE"}), (ape + old, {"APE", "TAG"}), (b"", set())):
        s = media.scan(stream + tail)
        assert len(s["offsets"]) == n and s["resyncs"] == 0 and set(s["tags"]) == {"PRIV"} | names
    s = media.scan(stream + b"junk in between" + old)
    assert len(s["offsets"]) == n and s["resyncs"] == 1 and "TAG" in s["tags"]


def bits_crc(bits: str) -> int:
    value = 0xFFFF
    for b in bits:
        top = value >> 15 ^ int(b)
        value = value << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return value


def binary(data: bytes) -> str:
    return "".join(f"{x:08b}" for x in data)


def test_checksums_of_layers_one_and_two():
    rng = random.Random(3)
    for second, layer in ((0xFE, 1), (0xFC, 2), (0xF4, 2)):
        for third in (0x10, 0x14, 0x18, 0x80, 0x94, 0xC8):
            for fourth in (0x00, 0x40, 0x60, 0x80, 0xC0):
                head = media.HEADERS.get(second << 8 | third)
                if head is None:
                    continue
                body = rng.randbytes(head[0] - 6)
                bits = binary(body + bytes(64))
                mode, bound = fourth >> 6, 4 * ((fourth >> 4 & 3) + 1) if fourth >> 6 == 1 else 32
                one = mode == 3
                if layer == 1:
                    n = sum((1 if one or band >= bound else 2) * 4 for band in range(32))
                else:
                    low, each = second == 0xF4, head[6] // (1 if one else 2)
                    widths = media.ALLOCATION["2" if low else ("d" if head[2] == 32000 else "c") if each <= 48 else "a" if head[2] == 48000 or each <= 80 else "b"]
                    at, kinds = 0, 0
                    for band, width in enumerate(widths):
                        for _ in range(1 if one or band >= bound else 2):
                            if "1" in bits[at : at + width]:
                                kinds += 2 if one or band < bound else 4
                            at += width
                    n = at + kinds
                good = bits_crc(binary(bytes([third, fourth])) + bits[:n])
                for value, want in ((good, True), (good ^ 0x0100, False)):
                    frame = bytes([0xFF, second, third, fourth]) + value.to_bytes(2, "big") + body
                    assert len(frame) == head[0]
                    assert media.check_sums(np.frombuffer(frame, np.uint8), [(0, head)], [0]).tolist() == [want]


SCHEMA = "doc_id long, text string, media string, feature int"


def plain(key, text):
    data = (text or "").encode()
    body = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    return key, len(data), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])


def check_digest(got, rows):
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got))) == sorted(str(plain(*r)) for r in rows)
    stored = {}
    for r, body in ((r, dict((plain(*x)[3], x[1]) for x in rows)[r.payload_sha256]) for r in got):
        data = (body or "").encode()
        stream = media.encode(data + bytes(r.payload_bytes - len(data)))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        frames, n, hz, bad, resyncs = map(int, re.fullmatch(r"frames=(\d+);seconds=(\d+)/(\d+);table=Xing:\1;bad=(\d+);resyncs=(\d+);seek=[0-9a-f]{8}", r.feature).groups()) if r.feature else ()
        places = [int(x) for x in r.seek_offsets.split()]
        assert (n, hz, bad, resyncs) == (1152 * frames, 32000, 0, 0) and len(places) == frames
        assert all(stream[p] == 0xFF and stream[p + 1] == 0xFA for p in places)
        stored.setdefault((r.payload_sha256), set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in stored.values())


def test_digest_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 63), (4, "a" * 64), (5, "a" * 65), (5, "é" * 500), (5, "é" * 500), (None, "null id"), (None, None), (6, "TAG" * 700), (7, "\0" * 70), (8, "ÿû\u0090À" * 600), (9, "long " * 400_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    check_digest(media.media_digest(df).collect(), rows)
    assert media.media_digest(df.limit(0)).count() == 0


def test_digest_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check_digest(queries.op10_mpeg_audio(spark, "/root/testdata/sf0.001").collect(), rows)


def test_streams_inspected(spark):
    payloads = [(1, b"x" * 5000), (1, b"x" * 5000), (2, b""), (3, None), (None, b"TAG" * 100)]
    streams = media.encode_media(spark.createDataFrame([(*r, 1) for r in payloads], "media_id long, payload binary, media int"))
    got = media.inspect_media(streams)
    assert got.count() == 5
    by_id = {r.media_id: r for r in got.collect()}
    n = by_id[1].n_frames
    assert n == -(-5000 // media._ROOM[-1]) and by_id[1].seconds == pytest.approx(n * 1152 / 32000) and by_id[1].samples == {32000: 1152 * n}
    assert by_id[1].seek_offsets == media.scan(media.encode(b"x" * 5000))["offsets"] and by_id[1].table == "Xing" and by_id[1].tags == ["PRIV"] and by_id[1].bad_checksums == 0
    assert by_id[3].n_frames == 0 and by_id[3].seconds == 0 and by_id[None].n_frames == 1
    assert media.inspect_media(streams.limit(0)).count() == 0
