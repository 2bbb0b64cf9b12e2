"""Best-fit packing of token pieces after Martello and Toth's dominance reduction.

Only a histogram of piece lengths, of at most `capacity` entries, reaches the driver.
There the reduction fixes sets of up to three lengths that dominate every alternative,
and best fit places what remains, longest first; both work on counts, so the plan's size
depends on the capacity and not on the corpus. Executors number the pieces of each
length and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, tidy
from .wordbpe import load


@dataclass
class Plan:
    """Blocks of sequences filled alike: copies, and what each holds as (length, times)."""

    capacity: int
    copies: list[int] = field(default_factory=list)
    fill: list[list[tuple[int, int]]] = field(default_factory=list)

    def add(self, copies: int, fill: list[tuple[int, int]]) -> None:
        if copies:
            self.copies.append(copies)
            self.fill.append(fill)


def reduce(count: np.ndarray, plan: Plan) -> None:
    """Martello and Toth's reduction: fix what dominates, and take it out of count.

    For each length in falling order, with rest the room beside one piece of it: nothing
    fits, so it stands alone; one piece fits the rest exactly, or no two pieces fit, so
    the longest that fits joins it; at most two fit, so the longest one joins it if it is
    as long as the best pair, or the best pair if it holds that longest one and no other
    second piece could do.
    """
    capacity = plan.capacity
    for size in range(capacity, 0, -1):
        while count[size]:
            rest = capacity - size
            count[size] -= 1  # the piece itself is no partner
            here = np.flatnonzero(count)
            small = np.repeat(here[:3], np.minimum(count[here[:3]], 3))[:3]
            fits = int(np.searchsorted(np.cumsum(small), rest, "right"))
            fitting = here[: np.searchsorted(here, rest, "right")]
            count[size] += 1
            if not fits:
                plan.add(int(count[size]), [(size, 1)])
                count[size] = 0
                continue
            best = int(fitting[-1])
            if fits == 1 or best == rest:
                partners = [best]
            elif fits == 2:
                partners = _pair(count, size, fitting, rest, best)
            else:
                break
            if not partners:
                break
            held = dict(zip(*np.unique([size, *partners], return_counts=True), strict=True))
            n = min(int(count[x]) // int(k) for x, k in held.items())
            plan.add(n, [(int(x), int(k)) for x, k in held.items()])
            for x, k in held.items():
                count[x] -= n * k


def _pair(count: np.ndarray, size: int, fitting: np.ndarray, rest: int, best: int) -> list[int]:
    own = lambda x: int(count[x]) - (x == size)
    total, a, b = 0, 0, 0
    for x in fitting[::-1]:
        at = int(np.searchsorted(fitting, min(rest - x, x), "right")) - 1
        if at >= 0 and fitting[at] == x and own(x) < 2:
            at -= 1
        if at >= 0 and x + fitting[at] > total:
            total, a, b = int(x + fitting[at]), int(x), int(fitting[at])
    if best >= total:
        return [best]
    if a != best:
        return []
    before = fitting[(fitting > b) & (fitting <= a)][:2]  # the pieces next longer than b
    next_two = np.repeat(before, [min(own(x) - (x == a), 2) for x in before])[:2]
    if len(next_two) < 2 or next_two.sum() > rest:
        return [a, b]
    return []


def best_fit(count: np.ndarray, plan: Plan) -> None:
    """Longest pieces first, each into the sequence with the least room that takes it."""
    room: list[int] = []  # with open sequences, ascending
    held: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(left: int, copies: int, fill: list[tuple[int, int]]) -> None:
        if not copies:
            return
        if left == 0:
            plan.add(copies, fill)
            return
        if left not in held:
            held[left] = []
            insort(room, left)
        held[left].append((copies, fill))

    for size in range(plan.capacity, 0, -1):
        n = int(count[size])
        count[size] = 0
        while n:
            at = bisect_left(room, size)
            if at < len(room):
                left = room[at]
                copies, fill = held[left].pop()
                if not held[left]:
                    del held[left]
                    room.pop(at)
            else:
                left, copies, fill = plan.capacity, n, []
            each = left // size  # a sequence stays the tightest until no more of these fit
            full = min(copies, n // each)
            put(left - each * size, full, [*fill, (size, each)])
            n -= full * each
            used = full
            if used < copies and n:
                put(left - n * size, 1, [*fill, (size, n)])
                n, used = 0, used + 1
            if fill:
                put(left, copies - used, fill)
    for left in room:
        for copies, fill in held[left]:
            plan.add(copies, fill)


def make_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    count = np.zeros(capacity + 1, np.int64)
    count[lengths] = counts
    plan = Plan(capacity)
    reduce(count, plan)
    best_fit(count, plan)
    return plan


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on, pieces a sequence, first sequence, first offset."""
    rows, next_rank, sequence = [], np.zeros(plan.capacity + 1, np.int64), 0
    for copies, fill in zip(plan.copies, plan.fill, strict=True):
        offset = 0
        for size, times in fill:
            rows.append((size, next_rank[size], times, sequence, offset))
            next_rank[size] += copies * times
            offset += size * times
        sequence += copies
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("size", "rank", "times", "sequence", "offset"), table.T, strict=True)) | {"first": np.searchsorted(table[:, 0], np.arange(plan.capacity + 2))}


def place(table: dict[str, np.ndarray], size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    span = np.int64(1) << 44  # more than any rank
    at = np.searchsorted(table["size"] * span + table["rank"], size * span + rank, "right") - 1
    nth = rank - table["rank"][at]
    return table["sequence"][at] + nth // table["times"][at], table["offset"][at] + nth % table["times"][at] * size


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def kernel(ids: pa.Array, texts: pa.Array) -> dict:
        got, offsets = load(path).encode(texts.to_pylist())
        out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32")}
        tail = np.array([end_id], "<u4").tobytes()
        raw = got.astype("<u4").tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = raw[4 * a : 4 * b] + tail
            for k, at in enumerate(range(0, b - a + 1, capacity)):
                part = own[4 * at : 4 * (at + capacity)]
                for name, x in zip(out, (i, k, at, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(x)
        whole = {k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()}
        return {"doc_id": ids.take(whole.pop("row")), **whole}

    kind = dict(df.dtypes)[id_col]
    return map_texts(df, kernel, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", id_col, text_col)


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into few sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text is its ids and one end_id, so null and empty texts are one piece of length 1.
    Longer texts than the capacity are cut into pieces of that length and a rest. Every
    row is packed, repeated ids and texts included. Other columns are not read. An empty
    table gives no rows. The pieces are checkpointed, since three steps read them; equal
    lengths are dealt over buckets, so a length that a third of all pieces share is not
    numbered in one task.
    """
    cut = checkpoint(pieces(df, path, capacity, end_id, id_col, text_col))
    spark = df.sparkSession
    histogram = cut.groupBy("length").count().collect()  # at most `capacity` rows
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = make_plan(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), capacity)
    table = spark.sparkContext.broadcast(slots(plan))  # bounded by the capacity

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("nth", F.row_number().over(within)).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(table.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(cut.dtypes)["doc_id"]
    return ranked.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
