"""MPEG audio columns: write payloads into frames, and read any stream's frames back.

A payload travels in the ancillary bytes of silent Layer III frames (32 kHz, mono,
no scale factors or samples, checksummed side information), behind an ID3v2 tag that
records its length and a variable-bitrate table. The reader takes any MPEG 1, 2 or 2.5
stream of Layers I to III with a stated bitrate: it skips tags, resynchronises after junk,
reads Xing, Info and VBRI tables, verifies checksums and gives exact durations and seek
offsets. Tags behind the audio are only looked for where a frame has ended, since a frame
may hold any bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat, map_texts, small_batches, tidy

# Fixed values of the MPEG audio standards: kbit/s by (MPEG 1?, layer), Hz by version bits, samples a frame.
RATES = {
    (True, 1): [32 * i for i in range(15)],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


# Bits of the allocation of each Layer II subband, by table: the standard's B.2a to B.2d, and that of MPEG 2.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "2": [4] * 4 + [3] * 7 + [2] * 19}


def _headers() -> dict[int, tuple[int, int, int, int, int, bool, int]]:
    """What the second and third byte of a header say: length, samples, Hz, layer, side bytes in stereo, checksum, kbit/s."""
    known = {}
    for second in range(0xE0, 0x100):
        version, layer, bare = second >> 3 & 3, 4 - (second >> 1 & 3), second & 1
        if version == 1 or layer == 4:
            continue
        one = version == 3
        for third in range(256):
            rate, hz = third >> 4, third >> 2 & 3
            if not 0 < rate < 15 or hz == 3:
                continue
            kbit, hertz, n = RATES[one, layer][rate], HERTZ[version][hz], SAMPLES[one, layer]
            if layer == 1:
                length = (12_000 * kbit // hertz + (third >> 1 & 1)) * 4
            else:
                length = n // 8 * 1000 * kbit // hertz + (third >> 1 & 1)
            known[second << 8 | third] = (length, n, hertz, layer, 32 if one else 17, not bare, kbit)
    return known


HEADERS = _headers()


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of a byte matrix."""
    value = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        value = CRC[(value >> 8 ^ column) & 0xFF] ^ (value << 8 & 0xFFFF)
    return value


_SIDE = 17
#: Payload bytes of a frame, and the frame's first bytes, by its bitrate's place in the table.
_ROOM: list[int] = []
_LEAD: list[bytes] = []
for _rate in range(1, 15):
    _head = bytes([0xFF, 0xFA, _rate << 4 | 2 << 2, 0xC0])
    _sum = int(crc16(np.frombuffer(_head[2:] + bytes(_SIDE), np.uint8)[None])[0])
    _LEAD.append(_head + _sum.to_bytes(2, "big") + bytes(_SIDE))
    _ROOM.append(HEADERS[_head[1] << 8 | _head[2]][0] - len(_LEAD[-1]))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """A stream that carries the payload losslessly."""
    full, rest = divmod(len(payload), _ROOM[-1])
    top = _LEAD[-1]
    frames = [top + payload[i : i + _ROOM[-1]] for i in range(0, full * _ROOM[-1], _ROOM[-1])]
    if rest:
        k = next(i for i, room in enumerate(_ROOM) if room >= rest)
        frames.append(_LEAD[k] + payload[full * _ROOM[-1] :] + bytes(_ROOM[k] - rest))
    size = sum(map(len, frames))
    own = b"lexmill.payload\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">IH", len(own), 0) + own
    ends = np.append(0, np.cumsum([len(x) for x in frames]))
    toc = (ends[np.arange(100) * len(frames) // 100] * 256 // max(size, 1)).astype(np.uint8).tobytes()
    table = bytes([0xFF, 0xFB, 1 << 4 | 2 << 2, 0xC0]) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), size + 144) + toc
    return b"".join([b"ID3\3\0\0", _syncsafe(len(tag)), tag, table, bytes(144 - len(table)), *frames])


def _header(data: bytes, at: int):
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 3] & 3 == 2:
        return None
    return HEADERS.get(data[at + 1] << 8 | data[at + 2])


def _resync(data: bytes, at: int) -> int:
    """The next place where a frame starts that another of its kind, or the end, follows; -1 if there is none."""
    while (at := data.find(0xFF, at)) >= 0:
        if (head := _header(data, at)) and at + head[0] <= len(data):
            then = at + head[0]
            if then == len(data) or data[then : then + 3] == b"TAG" or ((after := _header(data, then)) and after[1:4] == head[1:4]):
                return at
        at += 1
    return -1


def _front(data: bytes) -> tuple[int, dict[str, bytes]]:
    """Where audio begins, and the ID3v2 frames by name."""
    begin, found = 0, {}
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= len(data):
        major, flags = data[begin + 3], data[begin + 5]
        size = sum(b << s for b, s in zip(data[begin + 6 : begin + 10], (21, 14, 7, 0), strict=True))
        at, stop = begin + 10, min(begin + 10 + size, len(data))
        while major >= 3 and at + 10 <= stop and data[at] != 0:
            body = data[at + 4 : at + 8]
            n = sum(b << s for b, s in zip(body, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(body, "big")
            found.setdefault(data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + n, stop)])
            at += 10 + n
        begin = min(begin + 10 + size + 10 * (flags >> 4 & 1), len(data))
    return begin, found


def _behind(data: bytes) -> list[tuple[int, str, bytes]]:
    """What looks like ID3v1 and APE tags at the end, later ones first: begin, name, content."""
    found, end = [], len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
        found.append((end, "TAG", data[end + 3 :]))
    if data[max(end - 32, 0) : max(end - 24, 0)] == b"APETAGEX":
        begin = end - int.from_bytes(data[end - 20 : end - 16], "little") - (32 if data[end - 9] & 0x80 else 0)
        if 0 <= begin < end:
            found.append((begin, "APE", data[begin:end]))
    return found


def _vbr(data: bytes, at: int, head: tuple) -> dict | None:
    """The variable-bitrate table in the frame at this place."""
    mono = data[at + 3] >> 6 == 3
    side = (17 if mono else 32) if head[4] == 32 else (9 if mono else 17)
    x = at + 4 + side + 2 * head[5]
    if head[3] == 3 and data[x : x + 4] in (b"Xing", b"Info"):
        flags, y = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out = {"kind": data[x : x + 4].decode(), "frames": None, "bytes": None, "toc": None}
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                out[key] = data[y : y + n] if key == "toc" else int.from_bytes(data[y : y + n], "big")
                y += n
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big"), "toc": None}
    return None


def scan(data: bytes) -> dict:
    """Frames, tags, table and samples by rate of one stream. Checksums are compared in check_sums()."""
    begin, tags = _front(data)
    behind = _behind(data)
    offsets, ends, sums, resyncs, table, samples = [], [], [], 0, None, {}
    at, get, first = begin, HEADERS.get, True
    while at + 4 <= len(data):
        head = get(data[at + 1] << 8 | data[at + 2]) if data[at] == 0xFF and data[at + 3] & 3 != 2 else None
        if head is None or at + head[0] > len(data):
            if any(at == start for start, *_ in behind):
                break
            then = _resync(data, at + 1)
            resyncs += 1
            # a frame that only shows inside of what looks like a tag isn't one
            if then < 0 or any(at <= start <= then for start, *_ in behind):
                break
            at = then
            continue
        if first:
            first = False
            table = _vbr(data, at, head)
            if table:
                at += head[0]
                continue
        offsets.append(at)
        ends.append(at + head[0])
        if head[5]:
            sums.append((at, head))
        samples[head[2]] = samples.get(head[2], 0) + head[1]
        at += head[0]
    for start, name, content in behind:
        if start >= at:
            tags.setdefault(name, content)
    return {"offsets": offsets, "ends": ends, "sums": sums, "resyncs": resyncs, "table": table, "tags": tags, "samples": samples, "begin": begin}


def _protected(data: bytes, at: int, head: tuple) -> int:
    """Bits behind a Layer I or II checksum that it covers: the allocation and, in Layer II, the kinds of scale factors."""
    mode, ext = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    joint = 4 * (ext + 1) if mode == 1 else 32  # from this subband on, both channels share an allocation
    if head[3] == 1:
        return 4 * (min(joint, 32) * channels + (32 - joint) * (mode == 1))
    each = head[6] // channels
    if head[4] != 32:
        bits = ALLOCATION["2"]
    elif each <= 48:
        bits = ALLOCATION["d" if head[2] == 32000 else "c"]
    else:
        bits = ALLOCATION["a" if head[2] == 48000 or each <= 80 else "b"]
    stream, n = int.from_bytes(data[at + 6 : at + 6 + 64], "big"), 512
    used = kinds = 0
    for band, width in enumerate(bits):
        for _ in range(channels if band < joint else 1):
            used += width
            if stream >> (n - used) & ((1 << width) - 1):
                kinds += 2 * (1 if band < joint else channels)
    return used + kinds


def _bits_crc(data: bytes, at: int, n: int) -> int:
    """The checksum of a header's last two bytes and the n bits behind its checksum."""
    value = int(crc16(np.frombuffer(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n // 8], np.uint8)[None])[0])
    for k in range(n % 8):
        bit = data[at + 6 + n // 8] >> (7 - k) & 1
        value = (value << 1 ^ (0x8005 if (value >> 15) ^ bit else 0)) & 0xFFFF
    return value


def check_sums(data: np.ndarray, sums: list[tuple[int, tuple]], base: list[int]) -> np.ndarray:
    """Whether the stored checksum of each frame is right."""
    good = np.ones(len(sums), bool)
    at = np.array([x[0] for x in sums], np.int64) + np.array(base, np.int64)
    kind = np.array([(x[1][4] if x[1][3] == 3 else 0) for x in sums])
    mono = data[at + 3] >> 6 == 3 if len(at) else np.zeros(0, bool)
    for stereo in (32, 17):
        for one in (False, True):
            n = {(32, False): 32, (32, True): 17, (17, False): 17, (17, True): 9}[stereo, one]
            if len(i := np.flatnonzero((kind == stereo) & (mono == one))):
                rows = data[np.minimum(at[i][:, None] + np.array([2, 3, *range(6, 6 + n)]), len(data) - 1)]
                good[i] = crc16(rows) == data[at[i] + 4].astype(np.uint32) * 256 + data[at[i] + 5]
    for i in np.flatnonzero(kind == 0).tolist():
        frame = data[at[i] : at[i] + sums[i][1][0]].tobytes() + bytes(64)
        good[i] = _bits_crc(frame, 0, _protected(frame, 0, sums[i][1])) == int.from_bytes(frame[4:6], "big")
    return good


def payload(data: bytes, offsets: list[int], ends: list[int], tags: dict[str, bytes]) -> bytes:
    """What encode() was given."""
    n = struct.unpack(">Q", tags["PRIV"][-8:])[0]
    lead = len(_LEAD[0])
    return b"".join([data[a + lead : b] for a, b in zip(offsets, ends, strict=True)])[:n]


def inspect_media(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """media_id, n_frames, seconds, samples by rate, seek_offsets, tags, table, bad_checksums, resyncs of every stream.

    Null and empty streams have no frames and a duration of 0. Rows may repeat. Other columns are not read. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in cut(batch):
                out = []
                for data in part.column(1).to_pylist():
                    data = data or b""
                    s = scan(data)
                    good = check_sums(np.frombuffer(data, np.uint8), s["sums"], [0] * len(s["sums"]))
                    out.append({"n_frames": len(s["offsets"]), "seconds": sum(n / hz for hz, n in s["samples"].items()), "samples": list(s["samples"].items()), "seek_offsets": s["offsets"], "tags": sorted(s["tags"]), "table": s["table"]["kind"] if s["table"] else None, "bad_checksums": int((~good).sum()), "resyncs": s["resyncs"]})
                columns = {k: pa.array([x[k] for x in out], t) for k, t in (("n_frames", pa.int64()), ("seconds", pa.float64()), ("samples", pa.map_(pa.int32(), pa.int64())), ("seek_offsets", pa.list_(pa.int64())), ("tags", pa.list_(pa.string())), ("table", pa.string()), ("bad_checksums", pa.int64()), ("resyncs", pa.int64()))}
                yield pa.RecordBatch.from_pydict({"media_id": part.column(0), **columns})

    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("media_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(tidy(run), f"media_id {kind}, n_frames long, seconds double, samples map<int,long>, seek_offsets array<long>, tags array<string>, table string, bad_checksums long, resyncs long")


def encode_media(df: DataFrame, id_col: str = "media_id", payload_col: str = "payload") -> DataFrame:
    """media_id and media: binary payloads as streams, which inspect_media() reads; null stays null. Other columns are not read."""

    def run(batches):
        for batch in batches:
            for part in cut(batch):
                yield pa.RecordBatch.from_pydict({"media_id": part.column(0), "media": pa.array([None if x is None else encode(x) for x in part.column(1).to_pylist()], pa.binary())})

    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("media_id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(tidy(run), f"media_id {kind}, media binary")


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a stream, read it back and describe it.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of 64;
    null counts as empty, so its payload is 64 zero bytes. One row comes back for each
    row, equal texts with equal values; seek_offsets are the places of its frames. Other
    columns are not read. An empty table gives no rows.
    """

    def kernel(ids: pa.Array, texts: pa.Array) -> dict:
        data, offsets = flat(texts)
        raw, edges = data.tobytes(), offsets.tolist()
        streams = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            streams.append(encode(raw[a:b] + bytes(max(64, -(a - b) + (a - b) % 64) - (b - a))))
        scans = [scan(x) for x in streams]
        ends = np.cumsum([len(x) for x in streams])
        sums = [x for s in scans for x in s["sums"]]
        base = [int(e) - len(x) for x, e, s in zip(streams, ends, scans, strict=True) for _ in s["sums"]]
        good = check_sums(np.frombuffer(b"".join(streams), np.uint8), sums, base)
        bad = np.append(0, np.cumsum(~good))
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek_offsets")}
        k = 0
        for x, s in zip(streams, scans, strict=True):
            p = payload(x, s["offsets"], s["ends"], s["tags"])
            wrong = bad[k + len(s["sums"])] - bad[k]
            k += len(s["sums"])
            samples = ",".join(f"{n}/{hz}" for hz, n in s["samples"].items())  # exact seconds
            seek = zlib.crc32(np.array(s["offsets"], "<u8").tobytes())
            out["seek_offsets"].append(" ".join(map(str, s["offsets"])))
            out["payload_bytes"].append(len(p))
            out["payload_sha256"].append(hashlib.sha256(p).hexdigest())
            out["tail_crc32"].append(zlib.crc32(p[-64:]))
            out["media_bytes"].append(len(x))
            out["media_sha256"].append(hashlib.sha256(x).hexdigest())
            out["feature"].append(f"frames={len(s['offsets'])};seconds={samples};table={s['table']['kind']}:{s['table']['frames']};bad={wrong};resyncs={s['resyncs']};seek={seek:08x}")
        whole = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
        return {"doc_id": ids, "n_bytes": np.diff(offsets), **{k: pa.array(v, whole.get(k, pa.string())) for k, v in out.items()}}

    kind = dict(df.dtypes)[id_col]
    return map_texts(df, kernel, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets string", id_col, text_col)
