"""Removal of byte strings that an earlier document holds, by distributed prefix doubling.

A string's name stands for its rank and is made of its two halves' names: lengths 1, 2, 4,
8, 16 double in place, since no sort could separate them, and from GRAM bytes on
Spark brings equal names together by ranges, each range is sorted, and strings of one
document drop out. The next, longer round pairs names at a greater offset for what is
left, until a string is unique or as long as the threshold.

First round: of the GRAM-byte strings in each 50-byte window only the one with the least
name is ranked. Equal windows choose equal strings, so no match is lost, and a
sixteenth of all positions travel. Second round: the pair of the first and the last
window around it. If an earlier document has all that they span, its windows are decided
together; if no other document has the first string, they are unique. Third round: the
50-byte windows of what the second left open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCKS, home, receive, send
from .common import BYTE_WORD, checkpoint, cut, flat, groups, mix, small_batches, tidy

#: Bytes of the strings that the first round ranks.
GRAM = 20
#: Bits of a first-round name that travel; equal ones of different strings only cost work.
BITS = 48
#: First-round names that a task gathers before it writes a block for each range.
BLOCK_ROWS = 1_000_000
#: Bytes of a text that a kernel looks at together, and bits of a place in them.
SLICE, PLACE = 1 << 17, 18
_KEEP, _GONE, _OPEN = 0, 1, 2
_NTH = 40  # bits of a run's number in its text


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The names of strings from those of two parts."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def doubled(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Names of all strings of each length: pairs of names at offsets 1, 2, 4, ..., then of the powers of two that make up the length."""
    name, h = BYTE_WORD[data], 1
    out: list[tuple[np.ndarray, int] | None] = [None] * len(lengths)
    while True:
        for i, length in enumerate(lengths):
            if length & h:
                if out[i] is None:
                    out[i] = name, h
                else:
                    total, have = out[i]
                    n = max(len(data) - have - h + 1, 0)
                    out[i] = paired(total[:n], name[have : have + n]), have + h
        if 2 * h > max(lengths):
            return [x for x, _ in out]
        n = max(len(data) - 2 * h + 1, 0)
        right = name[h : h + n] >> np.uint64(29)
        right ^= name[h : h + n]
        name = name[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
        name += right
        h *= 2


def contexts(data: np.ndarray, offsets: np.ndarray, threshold: int) -> dict[str, np.ndarray]:
    """Runs of windows with the same least GRAM-byte string: text, first and last window, name, name of all they span; and every window's name.

    At most 2^PLACE bytes; see slices().
    """
    span = threshold - GRAM + 1  # strings in a window
    n = len(data) - threshold + 1
    none = {k: np.zeros(0, np.int64) for k in ("of", "first", "last")} | {k: np.zeros(0, np.uint64) for k in ("name", "around", "windows")}
    if n <= 0:
        return none
    name, whole = doubled(data, GRAM, threshold)
    # always as many bits for the place, so that windows choose alike whatever stands beside them
    least = name >> np.uint64(PLACE) << np.uint64(PLACE)
    least |= np.arange(len(name), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least[:n] & np.uint64((1 << PLACE) - 1)).astype(np.int32)
    del least
    size = np.maximum(np.diff(offsets) - threshold + 1, 0)
    starts = offsets[:-1][size > 0]
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + size[size > 0], -1)
    windows = np.flatnonzero(np.cumsum(valid[:n], dtype=np.int8))
    if not len(windows):
        return none
    at = at[windows]
    fresh = np.append(True, (at[1:] != at[:-1]) | (np.diff(windows) != 1))
    fresh[np.searchsorted(windows, starts)] = True
    lead = np.flatnonzero(fresh)
    first, last = windows[lead], windows[np.append(lead[1:], len(windows)) - 1]
    around = paired(whole[first], whole[last]) + (last - first).astype(np.uint64)  # the two windows meet or overlap, so they make up the span
    of = np.searchsorted(offsets, first, "right") - 1
    return {"of": of, "first": first, "last": last, "name": name[at[lead]], "around": mix(around), "windows": whole}


def slices(offsets: np.ndarray, overlap: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts cut every `size` bytes, each slice with `overlap` bytes of the next: text, begin and end of the slices, in groups of about `size` bytes.

    Where a text is cut depends on nothing but the text.
    """
    length = np.diff(offsets)
    n = np.maximum(-(-(length - overlap) // size), 1)
    of = np.repeat(np.arange(len(length)), n)
    begin = offsets[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * size
    end = np.minimum(begin + size + overlap, offsets[1:][of])
    total, at = np.cumsum(end - begin), 0
    while at < len(of):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield of[at:stop], begin[at:stop], end[at:stop]
        at = stop


def sliced_contexts(data: np.ndarray, offsets: np.ndarray, threshold: int) -> Iterator[dict[str, np.ndarray]]:
    """The contexts() of each group of slices, with the text of each run, its number there, and what leads from places to the text's."""
    seen = np.zeros(len(offsets) - 1, np.int64)
    for of, begin, end in slices(offsets, threshold - 1):
        joint = (begin[1:] == end[:-1]).all()
        part = data[begin[0] : end[-1]] if joint else np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        edges = np.append(0, np.cumsum(end - begin))
        runs = contexts(part, edges, threshold)
        own = runs["of"]
        runs["shift"] = (begin - offsets[:-1][of] - edges[:-1])[own]
        runs["of"] = text = of[own]
        runs["nth"] = seen[text] + np.arange(len(text)) - np.searchsorted(text, text)
        seen += np.bincount(text, minlength=len(seen))
        yield runs


def _smallest(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """The smallest document of each row's group; rows must stand in order of keys and document."""
    fresh = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    return doc[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]


def _gathered(sent: DataFrame, parts: int, n_columns: int, column: str) -> DataFrame:
    """doc, tag and one binary a document with the columns of all its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, n_columns)
        if got is None:
            return
        columns, doc, tag = got
        order = np.lexsort((columns[0], tag, doc))
        columns, doc, tag = [c[order] for c in columns], doc[order], tag[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
        ends = np.append(first[1:], len(doc))
        for a in range(0, len(first), 5000):
            rows = range(a, min(a + 5000, len(first)))
            body = [b"".join(c[first[r] : ends[r]].astype("<u4").tobytes() for c in columns) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first[rows.start : rows.stop]]), pa.array(tag[first[rows.start : rows.stop]]), pa.array(body, pa.binary())], names=["doc", "tag", column])

    return sent.repartitionById(parts, "part").mapInArrow(tidy(run), f"doc long, tag long, {column} binary")


def _verdicts(binary: pa.Array, n_columns: int) -> list[np.ndarray | None]:
    return [None if x is None else np.frombuffer(x, "<u4").reshape(n_columns, -1).astype(np.int64) for x in binary.to_pylist()]


def _decided(binary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Runs that the first two rounds have decided or left open, by text and number, and the verdict on each."""
    found = [(i, x) for i, x in enumerate(_verdicts(binary, 2)) if x is not None]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([(i << _NTH) + x[0] for i, x in found]), np.concatenate([x[1] for _, x in found])


def _with_verdict(runs: dict[str, np.ndarray], known: tuple[np.ndarray, np.ndarray], verdict: int) -> np.ndarray:
    """Which runs have this verdict."""
    key = (runs["of"] << _NTH) + runs["nth"]
    at = np.minimum(np.searchsorted(known[0], key), max(len(known[0]) - 1, 0))
    return np.flatnonzero((known[0][at] == key) & (known[1][at] == verdict)) if len(known[0]) else np.zeros(0, np.int64)


def _merged(begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans that intervals of texts cover: begin, end, text."""
    order = np.argsort(begin, kind="stable")
    begin, text = begin[order], text[order]
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    first = np.flatnonzero(np.append(True, (begin[1:] > reach[:-1]) | (text[1:] != text[:-1]))) if len(order) else np.zeros(0, np.int64)
    return begin[first], reach[np.append(first[1:], len(order))[: len(first)] - 1], text[first]


def remove_repeats(df: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", replace: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with replace, the rows themselves with what is left of the text.

    A byte goes if a string of `threshold` bytes around it also starts in a row with a smaller id;
    ids are whole numbers. Rows that share an id don't remove from each other, whether they
    are repeated or differ. A row with a null id neither removes nor loses anything. A null
    text counts as empty. A cut can split a UTF-8 character; a replaced text drops such partial
    characters, while the hash is of the exact bytes, and a null text stays null. Other columns
    are only read with replace. An empty
    table gives no rows.
    """
    if threshold < GRAM:
        raise ValueError(f"the threshold must be {GRAM} bytes at least")
    spark = small_batches(df.sparkSession)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = -(-parts // 4)  # far fewer verdicts go to their documents than names come from them
    rest = [F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("rest")] if replace else []
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *rest)
    repeated = not rows.groupBy("doc").count().where("doc IS NOT NULL AND count > 1").isEmpty()
    # rows of one id with different texts are told apart by a checksum, which would only cost room elsewhere
    rows = rows.withColumn("tag", F.coalesce(F.crc32("text"), F.lit(0)) if repeated else F.lit(0).cast("long"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            short, around, nth, doc, tag = (np.concatenate([x[k] for x in held]) for k in range(5))
            held.clear()
            yield from send((short * np.uint64(parts) >> np.uint64(BITS)).astype(np.int32), [short, around, nth], doc, tag)

        for batch in batches:
            for part in cut(batch.select(["doc", "text", "tag"])):
                doc, tag = part.column(0).to_numpy(), part.column(2).to_numpy()
                # least names are small ones, so ranges of them would be uneven
                for runs in sliced_contexts(*flat(part.column(1)), threshold):
                    of = runs["of"]
                    held.append((mix(runs["name"]) >> np.uint64(64 - BITS), runs["around"] >> np.uint64(16), runs["nth"], doc[of], tag[of]))
                    rows += len(of)
                    if rows > BLOCK_ROWS:
                        yield from flush()
                        rows = 0
        if held:
            yield from flush()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, 3)
        if got is None:
            return
        (short, around, nth), doc, tag = got
        order, fresh = groups(short)
        run = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(order))))
        doc_in = doc[order]
        several = (np.minimum.reduceat(doc_in, fresh) < np.maximum.reduceat(doc_in, fresh))[run]
        order, run = order[several], run[several]
        if not len(order):
            return
        inner = np.lexsort((doc[order], around[order], run))
        order, run = order[inner], run[inner]
        own_doc, own_around = doc[order], around[order]
        gone = _smallest([run, own_around], own_doc) < own_doc
        mixed = np.bincount(run, np.append(True, (run[1:] != run[:-1]) | (own_around[1:] != own_around[:-1])))[run] > 1
        verdict = np.where(gone, _GONE, np.where(mixed, _OPEN, _KEEP))
        order, verdict = order[verdict > 0], verdict[verdict > 0]
        yield from send(home(doc[order], homes), [nth[order], verdict], doc[order], tag[order])

    sent = rows.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "text", "tag").mapInArrow(tidy(name), BLOCKS).repartitionById(parts, "part").mapInArrow(tidy(rank), BLOCKS)
    first = checkpoint(_gathered(sent, homes, 2, "runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names, at, doc, tag = (np.concatenate([x[k] for x in held]) for k in range(4))
            held.clear()
            yield from send(((names >> np.uint64(16)) * np.uint64(parts) >> np.uint64(BITS)).astype(np.int32), [names, at], doc, tag)

        for batch in batches:
            batch = batch.select(["doc", "text", "tag", "runs"])
            for part in cut(batch.filter(batch.column(3).is_valid())):
                doc, tag, known = part.column(0).to_numpy(), part.column(2).to_numpy(), _decided(part.column(3))
                for runs in sliced_contexts(*flat(part.column(1)), threshold):
                    left = _with_verdict(runs, known, _OPEN)
                    if not len(left):
                        continue
                    size = runs["last"][left] - runs["first"][left] + 1
                    ends = np.cumsum(size)
                    at = np.repeat(runs["first"][left] - (ends - size), size) + np.arange(ends[-1])
                    names = runs["windows"][at]
                    of = np.repeat(runs["of"][left], size)
                    held.append((names, at + np.repeat(runs["shift"][left], size), doc[of], tag[of]))
                    rows += len(of)
                    if rows > BLOCK_ROWS:
                        yield from flush()
                        rows = 0
        if held:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, 2)
        if got is None:
            return
        (names, at), doc, tag = got
        order = np.lexsort((doc, names))
        gone = order[_smallest([names[order]], doc[order]) < doc[order]]
        yield from send(home(doc[gone], homes), [at[gone]], doc[gone], tag[gone])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch.select(["doc", "text", "runs", "at", *["rest"] * replace])):
                data, offsets = flat(part.column(1))
                known, begin, end, text = _decided(part.column(2)), [], [], []
                for runs in sliced_contexts(data, offsets, threshold):
                    gone = _with_verdict(runs, known, _GONE)
                    of = runs["of"][gone]
                    base = offsets[of] + runs["shift"][gone]
                    begin.append(base + runs["first"][gone])
                    end.append(base + runs["last"][gone] + threshold)
                    text.append(of)
                for i, x in enumerate(_verdicts(part.column(3), 1)):
                    if x is not None:
                        begin.append(offsets[i] + x[0])
                        end.append(offsets[i] + x[0] + threshold)
                        text.append(np.full(len(x[0]), i))
                begin, end, text = _merged(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, end, text)))
                spans = np.searchsorted(text, np.arange(part.num_rows + 1))
                raw, kept = memoryview(data), []
                for i, (a, b) in enumerate(zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True)):
                    edges = [int(offsets[i]), *np.stack([begin[a:b], end[a:b]], 1).ravel().tolist(), int(offsets[i + 1])]
                    kept.append(b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]))
                size = np.diff(offsets)
                out = {"doc_id": part.column(0), "n_bytes": size, "n_removed": size - np.array([len(x) for x in kept], np.int64), "n_spans": np.diff(spans), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
                if replace:
                    left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
                    out = {"rest": part.column(4), "text": pc.if_else(part.column(1).is_valid(), left, None)}
                yield pa.RecordBatch.from_pydict(out)

    joined = rows.join(first.hint("shuffle_hash"), ["doc", "tag"], "left")
    # no filter here: with the same columns and rows, both readers share one shuffle of the texts
    still = joined.mapInArrow(tidy(windows), BLOCKS)
    last = _gathered(still.repartitionById(parts, "part").mapInArrow(tidy(decide), BLOCKS), homes, 1, "at")
    both = joined.join(last.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "runs", "at", *["rest"] * replace)
    if replace:
        schema = T.StructType([rows.schema["rest"], T.StructField("text", T.StringType())])
        columns = [F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns]
        return both.mapInArrow(tidy(strip), schema).select(*columns)
    out = both.mapInArrow(tidy(strip), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kind = dict(df.dtypes)[id_col]
    return out if kind == "bigint" else out.withColumn("doc_id", F.col("doc_id").cast(kind))
