import hashlib
import random

import numpy as np

from lexmill.llm import blocks, substrings


def plain(rows: list[tuple], threshold: int = 50) -> list[tuple]:
    """By sets of all strings, ids in rising order."""
    seen: dict[bytes, int] = {}
    out = []
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - threshold + 1):
                w = data[i : i + threshold]
                seen[w] = min(seen.get(w, key), key)
    for key, text in rows:
        data = (text or "").encode()
        lost = bytearray(len(data))
        for i in range(len(data) - threshold + 1 if key is not None else 0):
            if seen[data[i : i + threshold]] < key:
                lost[i : i + threshold] = b"\1" * threshold
        kept = bytes(c for c, x in zip(data, lost, strict=True) if not x)
        out.append((key, len(data), sum(lost), sum(1 for x in bytes(lost).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows: list[tuple]) -> None:
    got = substrings.remove_repeats(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_removed int, runs string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain(rows)))


def test_shared_passages(spark):
    rng = random.Random(4)
    passages = ["".join(rng.choice("abé ") for _ in range(n)) for n in (48, 49, 50, 51, 52, 60, 75, 120, 400)]
    rows: list[tuple] = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            parts += ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))), p[a : len(p) - rng.randint(0, 8)]]
        rows.append((rng.randint(0, 10**6) * 100 + i, "".join(parts)))
    compare(spark, rows)


def test_runs_of_one_byte_and_overlaps(spark):
    compare(spark, [(5, "a" * 300), (3, "a" * 49 + "b" + "a" * 70), (9, "xa" * 90), (2, "ax" * 60), (11, "a" * 50), (12, "é" * 40), (13, "é" * 25), (14, "")])


def test_nulls_repeats_and_equal_ids(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again " * 3, "another text that is long enough to be looked at, twice, or more, or not"
    compare(spark, [(1, a), (1, a), (1, b), (2, b + "!"), (2, b + "!"), (None, a), (None, None), (3, None), (4, b[:49]), (0, b[10:])])
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_choose_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[3000:3200] = data[100:300]
    offsets = np.array([0, 0, 2000, 2040, 4000])
    runs = substrings.contexts(data, offsets, 50)
    windows = sorted((int(i), int(n)) for a, b, n in zip(runs["first"], runs["last"], runs["name"], strict=True) for i in range(a, b + 1))
    assert [i for i, _ in windows] == [i for a, b in ((0, 2000), (2000, 2040), (2040, 4000)) for i in range(a, b - 49)]
    name = dict(windows)
    assert all(name[100 + k] == name[3000 + k] for k in range(151))


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n, tags in ((1, 0), (500, 0), (500, 1)):
        columns = [rng.integers(0, 1 << 62, n).astype(np.uint64), rng.integers(0, 300, n).astype(np.uint64)]
        doc, tag = rng.integers(-50, 50, n), rng.integers(0, 5, n) * tags
        got, d, t = blocks.read_block(blocks.write_block(columns, doc, tag), 2)
        assert sorted(zip(*(x.tolist() for x in (*got, d, t)), strict=True)) == sorted(zip(*(x.tolist() for x in (*columns, doc, tag)), strict=True))
