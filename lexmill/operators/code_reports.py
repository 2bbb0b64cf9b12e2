"""Reports over sources: what an index build counts, and what compaction saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.code import compact_literals
from lexmill.functions.text import code_tokens


def index_counts(records: DataFrame) -> DataFrame:
    """One row: documents, parsed, unparsed, those with a recursive function and those with nested loops."""
    return records.agg(F.count("*").alias("documents"), F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("unparsed"), F.count_if(F.size("recursive_functions") > 0).alias("recursive"), F.count_if(F.col("max_loop_depth") >= 2).alias("nested"))


def _compacted(sources: DataFrame, length=None) -> DataFrame:
    """id, code, compacted and the length of both, by default in code tokens."""
    length = length or (lambda c: F.size(code_tokens(c)).cast("long"))
    both = sources.select("id", "code", compact_literals("code").alias("compacted"))
    return both.withColumns({"before": length(F.col("code")), "after": length(F.col("compacted"))})


def compaction_effect(sources: DataFrame, limits: tuple[int, ...] = (2048, 4096), length=None) -> DataFrame:
    """One row: sources that compaction changes, and the longest and those over each limit before and after; length is a column function."""
    c = _compacted(sources, length)
    over = [F.count_if(F.col(x) > n).alias(f"over_{n}_{x}") for n in limits for x in ("before", "after")]
    return c.agg(F.count("*").alias("documents"), F.count_if(~F.col("code").eqNullSafe(F.col("compacted"))).alias("changed"), F.max("before").alias("longest_before"), F.max("after").alias("longest_after"), *over, F.sum(F.length("code")).alias("chars_before"), F.sum(F.length("compacted")).alias("chars_after"))


def compaction_savings(sources: DataFrame, n: int = 10, length=None) -> DataFrame:
    """The n sources that lose most, by id among equals."""
    return _compacted(sources, length).select("id", "before", "after", (F.col("before") - F.col("after")).alias("saved")).orderBy(F.desc("saved"), "id").limit(n)
