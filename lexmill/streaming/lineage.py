"""Versions that arrive as a stream: each batch is classified against the stored log and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.versions import APPEND_THRESHOLD, RECORD, append

STORED = f"{RECORD}, fingerprint string, previous_similarity double, change_type string, append_seq long, batch long"


def append_stream(incoming: DataFrame, path: str, checkpoint: str, threshold: float = APPEND_THRESHOLD, available_now: bool = True, fingerprint: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """Start appending a stream of (logical_id, version, code, arrival, deleted, and more of a record) to the log at path.

    A batch that is replayed after a failure writes under its own number again, replacing what the
    failed attempt left, and is classified against earlier batches only; so a version is stored once.
    fingerprint says when two codes are the same; see versions.append().
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.schema(STORED).parquet(path).where(F.col("batch") < number).drop("batch")
        except Exception as e:  # no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], STORED).drop("batch")
        append(stored, batch, "append_seq", threshold, fingerprint=fingerprint).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = incoming.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
