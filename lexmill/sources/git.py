"""Git history as a data source: one partition a commit, read with plumbing commands that change nothing."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "commit_ord int, commit string, path string, version string, code string"
MOST_BYTES = 1_000_000


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def check_path(path: str) -> str:
    parts = path.split("/")
    if path.startswith("/") or ".." in parts or not path.endswith(".py"):
        raise ValueError(f"not a relative path of a Python file: {path}")
    return path


def listed(repo: str, ref: str = "HEAD", most: int = 20) -> list[str]:
    """The last commits of a reference along first parents, oldest first."""
    if most < 1:
        raise ValueError("at least one commit must be asked for")
    tip = git(repo, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").decode().strip()
    return git(repo, "rev-list", "--first-parent", "--reverse", f"--max-count={most}", tip).decode().split()


def is_ancestor(repo: str, old: str, new: str) -> bool:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True).returncode == 0


def has_parents(repo: str, sha: str) -> bool:
    return len(git(repo, "rev-list", "--parents", "-n", "1", sha).split()) > 1


class Commit(InputPartition):
    def __init__(self, order: int, sha: str):
        self.order, self.sha = order, sha


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.ref = options["path"], options.get("ref", "HEAD")
        self.most = int(options.get("max_commits", "20"))
        self.paths = [check_path(p) for p in options["files"].split(",")]
        self.commits = options["commits"].split(",") if options.get("commits") else None

    def partitions(self) -> Sequence[InputPartition]:
        return [Commit(i, sha) for i, sha in enumerate(self.commits if self.commits is not None else listed(self.repo, self.ref, self.most))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Commit)
        for path in self.paths:
            entry = git(self.repo, "ls-tree", partition.sha, "--", path).decode().split()
            if len(entry) < 3 or entry[0] not in ("100644", "100755"):
                yield partition.order, partition.sha, path, None, None
                continue
            data = git(self.repo, "cat-file", "blob", entry[2])
            if len(data) > MOST_BYTES:
                raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
            yield partition.order, partition.sha, path, entry[2], data.decode("utf-8")


class GitSource(DataSource):
    """spark.dataSource.register(GitSource); format("lexmill_git") with options path, files, ref, max_commits, or commits.

    The repository must be at that path on every executor. A path that a commit doesn't have gives nulls.
    """

    @classmethod
    def name(cls) -> str:
        return "lexmill_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)
