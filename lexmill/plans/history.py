"""A repository's history as an append-only log of versions, with a snapshot after every commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.code import code_fingerprint
from lexmill.operators import versions
from lexmill.operators.versions import InvalidHistory
from lexmill.sources import git

COMMITS = "commit_ord int, commit string, files string"
SNAPSHOTS = "commit_ord int, commit string, logical_id string, version string"
LOG = f"{versions.RECORD}, fingerprint string, previous_similarity double, change_type string, append_seq long"


def stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the store, empty if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def import_history(spark: SparkSession, repo: str, files: list[str], folder: str, ref: str = "HEAD", max_commits: int = 20, encode: Callable[[Column], Column] | None = None, dims: int = 0, threshold: float = versions.APPEND_THRESHOLD) -> int:
    """Append the new commits' changes of some files to the log, commits and snapshots in a folder; the number of changes.

    Replaying commits that are stored changes nothing. Other files than before are an error, and so are new commits that don't
    descend from the last stored one, since a log only grows. A commit is listed last, when its versions and snapshots are
    written, so a failed import is done again by the next one.
    """
    spark.dataSource.register(git.GitSource)
    names = ",".join(sorted(git.check_path(f) for f in files))
    known = stored(spark, folder, "commits", COMMITS).orderBy("commit_ord").collect()  # a row a commit
    if known and known[0].files != names:
        raise InvalidHistory("a history keeps the files that it began with")
    shas = git.listed(repo, ref, max_commits)
    held = {r.commit for r in known}
    new = [x for x in shas if x not in held]
    if not new:
        return 0
    last = known[-1] if known else None
    if last is not None and not all(git.is_ancestor(repo, last.commit, x) for x in new):
        raise InvalidHistory("older or divergent commits can't be appended")
    window = ([last.commit] if last else []) + new
    number = {x: (last.commit_ord if last else 0) + i for i, x in enumerate(window)}
    order = F.element_at(F.create_map(*(F.lit(y) for x, n in number.items() for y in (x, n))), F.col("commit"))
    rows = spark.read.format("lexmill_git").option("path", repo).option("files", names).option("commits", ",".join(window)).load().withColumn("commit_ord", order)
    events = versions.commit_events(rows, baseline=last is None and git.has_parents(repo, window[0]))
    if last is not None:
        events = events.where(F.col("commit_ord") > last.commit_ord)
    events = events.cache()
    try:
        log = stored(spark, folder, "versions", LOG + (", vec array<float>" if encode else ""))
        metadata = F.create_map(F.lit("commit"), F.col("commit"), F.lit("path"), F.col("path"), F.lit("operation"), F.col("operation"))
        incoming = events.select(
            F.col("path").alias("logical_id"), F.col("commit").alias("version"), F.coalesce("code", F.lit("")).alias("code"), F.col("path").alias("title"), F.lit("python").alias("language"),
            metadata.alias("metadata"), F.col("commit_ord").alias("arrival"), (F.col("operation") == "deleted").alias("deleted"),
        )
        appended = versions.append(log, incoming, threshold=threshold, fingerprint=code_fingerprint, encode=encode, dims=dims)
        count = events.count()
        before = stored(spark, folder, "snapshots", SNAPSHOTS).where(F.col("commit_ord") == (last.commit_ord if last else -1))
        starts = before.where("logical_id IS NOT NULL").select("commit_ord", F.col("logical_id").alias("path"), "version").distinct()
        changed = events.select("commit_ord", "path", F.when(F.col("operation") != "deleted", F.col("commit")).alias("version"))
        commits = spark.createDataFrame([(number[x], x, names) for x in new], COMMITS)
        spans = versions.carry_forward(starts.unionByName(changed), commits.select("commit_ord"))
        snapshots = spans.join(F.broadcast(commits.select("commit_ord", "commit")), "commit_ord").select("commit_ord", "commit", F.col("path").alias("logical_id"), "version")
        if count:
            appended.write.mode("append").parquet(f"{folder}/versions")
        # a commit without files has a row too, so that it is known
        known_commits = commits.select("commit_ord", "commit", F.lit(None).cast("string").alias("logical_id"), F.lit(None).cast("string").alias("version"))
        snapshots.unionByName(known_commits).write.mode("append").parquet(f"{folder}/snapshots")
        commits.write.mode("append").parquet(f"{folder}/commits")
    finally:
        events.unpersist()
    return count
