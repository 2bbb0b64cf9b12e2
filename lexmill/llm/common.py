"""What the training-data operators share: reading, byte-bounded Arrow batches, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel sees at once; a longer text comes alone.
BATCH_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows, and bytes, that Spark hands to Python at once. With texts of some KB each, its own defaults make batches of tens of MB, with long ones of GB.
BATCH_ROWS, ARROW_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Make the session's Arrow batches no longer than BATCH_ROWS and, but for a single row, ARROW_BYTES; settings that results don't depend on."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))  # Spark adds a unit to bytes
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))
    return spark


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel, which hands memory that it no longer uses back to the system when its task ends.

    Workers go on to other tasks, and allocators would keep each one's peak.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def cut(batch: pa.RecordBatch, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch whose second column is text into runs of rows of about max_bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the n+1 offsets of its rows; null counts as empty."""
    column = pc.cast(column.fill_null(""), pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(
    df: DataFrame,
    kernel: Callable[[pa.Array, pa.Array], dict],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Rows of kernel(ids, texts) over byte-bounded batches; no shuffle, and only two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, max_bytes):
                yield pa.RecordBatch.from_pydict(kernel(part.column(0), part.column(1)))

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts mask() accepts; no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["id", "text"])
            kept = [mask(part.column(1)) for part in cut(both)]
            yield batch.filter(pa.array(np.concatenate(kept), pa.bool_())) if kept else batch

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), df.schema)


#: Characters from which a text is worked through in pieces.
LONG = 1 << 20
_BETWEEN = re.compile(r"(?<=\w) (?=\w)")


def at_blanks(texts: list[str | None], most: int | None = None) -> tuple[list[str | None], np.ndarray]:
    """Texts cut at the next blank between two words after every `most` characters, without that blank, and the first piece of each text (n+1 of them)."""
    most = most or LONG
    pieces: list[str | None] = []
    first = [0]
    for text in texts:
        at = 0
        while text is not None and len(text) - at > most and (m := _BETWEEN.search(text, at + most)):
            pieces.append(text[at : m.start()])
            at = m.end()
        pieces.append(text[at:] if at else text)
        first.append(len(pieces))
    return pieces, np.array(first)


def by_size(pieces: list[str | None], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of pieces with about `most` characters."""
    most = most or LONG
    at = size = 0
    for i, x in enumerate(pieces):
        size += len(x or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(pieces):
        yield at, len(pieces)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each [offsets[i], offsets[i+1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, odd: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2^64."""
    if odd not in _POWERS or len(_POWERS[odd][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (odd, pow(odd, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[odd] = (both[0], both[1])
    up, down = _POWERS[odd]
    return up[:n], down[:n]


#: A random 64-bit word for every byte, from a fixed rule.
BYTE_WORD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def prefix_hash(words: np.ndarray, odd: int = _ODD) -> np.ndarray:
    """Prefix sums of words[i] * odd^i; see span_hash."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words), odd)[0], out=total[1:])
    return total


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: int = _ODD) -> np.ndarray:
    """Rolling hash of [starts, ends), the same wherever the content stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), odd)[1][starts])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for data between jobs in spark.checkpoint.dir; without one, a temporary folder where all of Spark runs in one process, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, compressed by column; drop() deletes them when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the driver look for shuffles that nothing refers to any more, so that their files go now and not when its memory happens to fill."""
    gc.collect()
    spark._jvm.System.gc()


def stored_bytes(table: DataFrame) -> int:
    """Bytes of a table that is read from files, by their sizes; no job runs."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run without white space, and the first word of each text (n+1 of them)."""
    white = WHITE[data]
    begin, stop = ~white, ~white
    begin[1:] &= white[:-1]
    stop[:-1] &= white[1:]
    filled = np.diff(offsets) > 0
    edge, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[edge] = ~white[edge]
    stop[last] = ~white[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, earlier ones first, and where each group starts in it."""
    n = len(keys)
    bits = np.uint64(max(n - 1, 1).bit_length())
    packed = (keys >> bits << bits) | np.arange(n, dtype=np.uint64)  # sorting values is far quicker than argsort
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    if (fresh[1:] & (packed[1:] >> bits == packed[:-1] >> bits)).any():  # two keys share their upper bits
        order = np.argsort(keys, kind="stable")
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, np.flatnonzero(fresh)


def text_salt(n: int) -> np.ndarray:
    """A random word for each text of a batch."""
    return mix(np.arange(1, n + 1, dtype=np.uint64))
