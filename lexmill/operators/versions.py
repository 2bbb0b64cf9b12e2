"""Versioned records: change classes, lineages, snapshots, scopes and incremental appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import jaccard, text_fingerprint, token_set

#: Similarity from which a change is a near duplicate: of batch lineages, and of appended versions.
BATCH_THRESHOLD, APPEND_THRESHOLD = 0.82, 0.75
SCOPES = ("all", "latest", "commit")


class InvalidHistory(ValueError):
    """Versions that can't be appended, or a commit that isn't there."""


def change_class(first: Column, same: Column, similarity: Column, threshold: float, deleted: Column | None = None) -> Column:
    kind = F.when(first, "initial").when(same, "unchanged").when(similarity >= threshold, "near_duplicate_update").otherwise("substantial_update")
    return kind if deleted is None else F.when(deleted, "deleted").otherwise(kind)


def changes(records: DataFrame, order: str, threshold: float = BATCH_THRESHOLD, fingerprint: Column | None = None, code: str = "code", deleted: Column | None = None) -> DataFrame:
    """Adds fingerprint, previous_similarity and change_type against the version before, by `order` within logical_id.

    The first version has a null similarity; an equal fingerprint has 1. Equal places in the order
    are told apart by fingerprint.
    """
    rows = records.withColumn("fingerprint", text_fingerprint(F.col(code)) if fingerprint is None else fingerprint).withColumn("_tokens", token_set(F.col(code)))
    window = Window.partitionBy("logical_id").orderBy(order, "fingerprint")
    rows = rows.withColumns({"_n": F.row_number().over(window), "_before": F.lag("_tokens").over(window), "_print": F.lag("fingerprint").over(window)})
    first, same = F.col("_n") == 1, F.col("fingerprint") == F.col("_print")
    similarity = F.when(first, F.lit(None).cast("double")).when(same, 1.0).otherwise(jaccard(F.col("_tokens"), F.col("_before")))
    rows = rows.withColumn("previous_similarity", similarity)
    return rows.withColumn("change_type", change_class(first, same, F.col("previous_similarity"), threshold, deleted)).drop("_n", "_before", "_print", "_tokens")


def stats(changed: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("change_type") == kind)
    return changed.agg(F.count_distinct("logical_id").alias("lineages"), F.count("*").alias("versions"), count("unchanged").alias("unchanged"), count("near_duplicate_update").alias("near_duplicate"), count("substantial_update").alias("substantial"))


def history(records: DataFrame, order: str, *columns: str) -> DataFrame:
    """logical_id, version_count, timeline: all versions of a lineage in order."""
    item = F.struct(order, *(c for c in columns if c != order))
    return records.groupBy("logical_id").agg(F.count("*").alias("version_count"), F.array_sort(F.collect_list(item)).alias("timeline"))


def timeline_until(hits: DataFrame, records: DataFrame, order: str, truncate: bool = True) -> DataFrame:
    """Versions of each hit's lineage, up to the hit itself if truncated; one row a hit and version."""
    theirs = records.select("logical_id", F.col(order).alias("at"), "version", "change_type")
    pairs = hits.select("logical_id", F.col(order).alias("hit_at")).join(theirs, "logical_id")
    return pairs.where(F.col("at") <= F.col("hit_at")) if truncate else pairs


def carry_forward(events: DataFrame, commits: DataFrame) -> DataFrame:
    """commit_ord, path, version after every commit: the last change of each path, until a deletion.

    events: commit_ord, path, version (null for a deletion). A path has no row before its first version.
    Commits are numbered without gaps, so a change lasts for a sequence of numbers.
    """
    window = Window.partitionBy("path").orderBy("commit_ord")
    last = commits.agg(F.max("commit_ord").alias("last"))  # one row
    spans = events.withColumn("until", F.lead("commit_ord").over(window)).where("version IS NOT NULL").crossJoin(F.broadcast(last))
    ends = F.coalesce(F.col("until") - 1, F.col("last"))
    return spans.where(F.col("commit_ord") <= ends).select(F.explode(F.sequence("commit_ord", ends)).alias("commit_ord"), "path", "version")


def in_scope(records: DataFrame, scope: str, order: str, snapshots: DataFrame | None = None, commit: str | None = None) -> DataFrame:
    """Versions that a scope lets through; deletions never do.

    snapshots: commit_ord, commit, logical_id, version. `latest` is the last commit's snapshot, or each
    lineage's last version without snapshots. An unknown commit is an error.
    """
    if scope not in SCOPES:
        raise InvalidHistory(f"unknown scope {scope}")
    live = F.col("change_type") != "deleted"
    if scope == "all":
        return records.where(live)
    if scope == "latest" and snapshots is None:
        last = records.groupBy("logical_id").agg(F.max(order).alias(order))
        return records.join(last, ["logical_id", order], "left_semi").where(live)
    if snapshots is None:
        raise InvalidHistory("there are no snapshots")
    if scope == "latest":
        commits = snapshots.agg(F.max_by("commit", "commit_ord").alias("commit"))
        chosen = snapshots.join(F.broadcast(commits), "commit", "left_semi")
    else:
        chosen = snapshots.where(F.col("commit") == commit)
        if chosen.isEmpty():
            raise InvalidHistory(f"unknown commit {commit}")
    return records.join(chosen, ["logical_id", "version"], "left_semi").where(live)


#: What a version's record holds; incoming ones may lack all but the first three, and `vec`.
RECORD = "logical_id string, version string, code string, title string, language string, metadata map<string,string>"


def append(
    stored: DataFrame,
    incoming: DataFrame,
    order: str = "append_seq",
    threshold: float = APPEND_THRESHOLD,
    strict: bool = False,
    fingerprint: Callable[[Column], Column] | None = None,
    encode: Callable[[Column], Column] | None = None,
    dims: int = 0,
) -> DataFrame:
    """The new rows to add: versions not stored yet, numbered after the stored ones and classified against them, with all their columns.

    incoming: logical_id, version, code, arrival, deleted, and whatever else a record holds. Versions already stored are skipped, or an error
    if strict; so are repeats within the batch, of which the first arrival counts. Only the last stored
    version of the lineages at hand is read beside the new rows.

    fingerprint says when two codes are the same, functions.code.code_fingerprint for Python; by default texts are compared with white space
    collapsed. With encode, a column function from code to a vector of `dims` numbers, rows get `vec`: only changed versions are encoded, an unchanged one
    takes the vector of the version before, a deleted one has zeros. stored then has vec as well.
    """
    key = ["logical_id", "version"]
    if strict and not incoming.join(stored, key, "left_semi").isEmpty():
        raise InvalidHistory("a version is stored already")
    others = [c for c in incoming.columns if c not in (*key, "code", "arrival", "deleted", "vec", "fingerprint", "previous_similarity", "change_type", order)]
    new = incoming.join(stored, key, "left_anti")
    first = Window.partitionBy(*key).orderBy("arrival")
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    held = [c for c in ("version", "code", *(["vec"] if encode is not None else []))]
    last = stored.groupBy("logical_id").agg(F.max_by(F.struct(*held), order).alias("last"), F.max(order).alias("seq")).join(new.select("logical_id").distinct(), "logical_id", "left_semi")
    base = last.select("logical_id", "last.*", F.lit(-1).cast("long").alias("arrival"), F.lit(False).alias("deleted"), F.lit(True).alias("_old"))
    rows = new.select(*key, "code", F.col("arrival").cast("long").alias("arrival"), "deleted", *others, F.lit(False).alias("_old"))
    rows = base.unionByName(rows, allowMissingColumns=True)
    out = changes(rows, "arrival", threshold, None if fingerprint is None else fingerprint(F.col("code")), deleted=F.col("deleted"))
    if encode is not None:
        out = _with_vectors(out, encode, dims)
    start = last.select("logical_id", "seq")
    nth = F.row_number().over(Window.partitionBy("logical_id").orderBy("arrival"))
    fresh = out.where(~F.col("_old")).withColumn("_nth", nth).join(start, "logical_id", "left")
    made = ["vec"] if encode is not None else []
    return fresh.select(*key, "code", *others, "fingerprint", "previous_similarity", "change_type", *made, (F.coalesce("seq", F.lit(-1)) + F.col("_nth")).alias(order))


def _with_vectors(out: DataFrame, encode: Callable[[Column], Column], dims: int) -> DataFrame:
    wanted = ~F.col("_old") & ~F.col("change_type").isin("unchanged", "deleted")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    rest = out.where(~wanted).withColumn("vec", F.when(F.col("change_type") == "deleted", zeros).otherwise(F.col("vec")))
    both = out.where(wanted).drop("vec").withColumn("vec", encode(F.col("code"))).unionByName(rest)
    before = Window.partitionBy("logical_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("vec", F.last("vec", ignorenulls=True).over(before))


def storage(log: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: lineages, versions, bytes of their vectors in all and of one."""
    return log.agg(F.count_distinct("logical_id").alias("lineages"), F.count("*").alias("versions"), F.coalesce(F.sum(4 * F.size(vec)), F.lit(0)).alias("vector_bytes"), F.coalesce(F.max(4 * F.size(vec)), F.lit(0)).alias("bytes_per_version"))


def commit_events(files: DataFrame, baseline: bool = False) -> DataFrame:
    """commit_ord, commit, path, version, code, operation of every change: added, modified or deleted.

    files: commit_ord, commit, path, version (null where a commit lacks the path), code; versions name contents. With baseline, what the first commit
    holds was there before.
    """
    window = Window.partitionBy("path").orderBy("commit_ord")
    rows = files.withColumns({"_before": F.lag("version").over(window), "_n": F.row_number().over(window)})
    changed = rows.where(~F.col("version").eqNullSafe(F.col("_before")))
    first = F.lit("baseline") if baseline else F.lit("added")
    operation = F.when(F.col("version").isNull(), "deleted").when(F.col("_n") == 1, first).when(F.col("_before").isNull(), "added").otherwise("modified")
    return changed.withColumn("operation", operation).drop("_before", "_n")


def pending(wanted: DataFrame, cached: DataFrame, *key: str) -> DataFrame:
    """What a resumable computation still has to do."""
    return wanted.join(cached, list(key), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows replace those of the same key."""
    return table.join(rows, list(key), "left_anti").unionByName(rows)
