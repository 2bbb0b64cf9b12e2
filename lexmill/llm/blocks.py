"""Columns of numbers on their way between tasks, packed in one binary a block and receiver.

A row for each number would cost a shuffle several times as many bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix


_ZSTD = pa.Codec("zstd", compression_level=1)


def _trim(x: np.ndarray, n: int) -> bytes:
    """The n lower bytes of each number, lowest ones of all first: the upper ones are alike and compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _widen(data: bytes, at: int, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, count * n, at).reshape(n, count).T
    return out.view("<u8").ravel()


def _bytes(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def write_block(columns: list[np.ndarray], doc: np.ndarray, tag: np.ndarray) -> bytes:
    """Columns of small or sorted numbers with the document of each; the first column's differences are stored, and each document once."""
    doc, tag = doc.astype(np.int64), tag.astype(np.int64)
    if tag.any():
        docs, which = np.unique(np.stack([doc, tag], 1), axis=0, return_inverse=True)
        ids, tags = docs[:, 0], docs[:, 1].view(np.uint64)
    else:
        ids, which = np.unique(doc, return_inverse=True)
        tags = np.zeros(0, np.uint64)
    order = np.argsort(columns[0], kind="stable")
    steps = np.diff(columns[0][order].astype(np.uint64), prepend=np.uint64(0))
    base, steps[0] = int(steps[0]), 0
    gaps = np.diff(ids, prepend=ids[:1]).view(np.uint64)
    packed = [gaps, tags, steps, *(c[order].astype(np.uint64) for c in columns[1:]), which.ravel()[order].astype(np.uint64)]
    sizes = [_bytes(c) for c in packed]
    head = np.array([len(order), len(ids), len(tags), base, int(ids[0]) & (1 << 64) - 1, *sizes], np.uint64)
    body = b"".join([_trim(c, s) for c, s in zip(packed, sizes, strict=True)])
    return head.tobytes() + _ZSTD.compress(body, asbytes=True)


def read_block(data: bytes, n_columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    head = np.frombuffer(data, np.uint64, 8 + n_columns)
    n, n_docs, n_tags = (int(x) for x in head[:3])
    counts, sizes = [n_docs, n_tags] + [n] * (n_columns + 1), head[5:].astype(np.int64).tolist()
    body = _ZSTD.decompress(memoryview(data)[head.nbytes :], sum(c * s for c, s in zip(counts, sizes, strict=True)), asbytes=True)
    at, packed = 0, []
    for count, size in zip(counts, sizes, strict=True):
        packed.append(_widen(body, at, count, size))
        at += count * size
    ids = np.cumsum(packed[0].view(np.int64)) + head[4:5].view(np.int64)[0]
    which = packed.pop().astype(np.int64)
    columns = packed[2:]
    columns[0] = np.cumsum(columns[0]) + head[3]
    return columns, ids[which], packed[1].view(np.int64)[which] if n_tags else np.zeros(n, np.int64)


def send(part: np.ndarray, columns: list[np.ndarray], doc: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block for each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    for p, rows in zip(parts.tolist(), np.split(order, first[1:]), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([write_block([c[rows] for c in columns], doc[rows], tag[rows])], pa.binary())], names=["part", "block"])


def receive(batches: Iterator[pa.RecordBatch], n_columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    got = [read_block(x, n_columns) for batch in batches for x in batch.column(1).to_pylist()]
    if not got:
        return None
    return [np.concatenate([g[0][k] for g in got]) for k in range(n_columns)], np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])


BLOCKS = "part int, block binary"


def home(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
