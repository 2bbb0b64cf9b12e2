"""Checks of rankings, labels and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_problems(run: DataFrame, queries: DataFrame, docs: DataFrame, length: int = 100) -> DataFrame:
    """qid, problem: missing and extra queries, rankings of another length, repeated and unknown documents."""
    own = run.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct"))
    say = lambda d, text: d.select("qid", F.lit(text).alias("problem")).distinct()
    out = say(queries.join(own, "qid", "left_anti"), "missing query")
    out = out.unionByName(say(own.join(queries, "qid", "left_anti"), "extra query"))
    out = out.unionByName(say(own.where(F.col("n") != length), "wrong length"))
    out = out.unionByName(say(own.where(F.col("n") > F.col("distinct")), "repeated document"))
    return out.unionByName(say(run.join(docs, "doc_id", "left_anti"), "unknown document"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables of ids have the same set of them, how many only one has, and how many repeat."""
    left = a.groupBy(*a.columns).agg(F.count("*").alias("n_a"))
    both = left.join(b.groupBy(*b.columns).agg(F.count("*").alias("n_b")), a.columns, "full")
    only_a, only_b = F.count_if(F.col("n_b").isNull()), F.count_if(F.col("n_a").isNull())
    return both.agg(((only_a == 0) & (only_b == 0)).alias("same"), only_a.alias("only_a"), only_b.alias("only_b"), F.count_if((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("repeated"))


def in_partition(df: DataFrame, name: str, column: str = "partition") -> DataFrame:
    """The rows of one partition, train or test; the filter reaches the scan."""
    if name not in ("train", "test"):
        raise ValueError(f"unknown partition {name}")
    return df.where(F.col(column) == name)


def only_keys(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows whose key is listed; repeated keys in the list don't repeat rows."""
    return df.join(keys.select(*on), list(on), "left_semi")


def selection_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both, of what they share and of what only one has."""
    both = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), a.columns, "full")
    has_a, has_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(F.count_if(has_a).alias("n_a"), F.count_if(has_b).alias("n_b"), F.count_if(has_a & has_b).alias("shared"), F.count_if(has_a & ~has_b).alias("only_a"), F.count_if(has_b & ~has_a).alias("only_b"))


def label_alignment(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """alignment, n: whether both sides of each pair (a, b) have the same link once blanks are trimmed.

    left: a, url; right: b, url. A pair with an absent or empty link is missing.
    """
    joined = pairs.join(left.withColumnRenamed("url", "url_a"), "a", "left").join(right.withColumnRenamed("url", "url_b"), "b", "left")
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kind = F.when((clean("url_a") == "") | (clean("url_b") == ""), "missing").when(clean("url_a") == clean("url_b"), "matched").otherwise("mismatched")
    return joined.groupBy(kind.alias("alignment")).agg(F.count("*").alias("n"))


def hash_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows whose keys hash lowest: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def hash_split(key: Column, share: float, seed: int) -> Column:
    """`train` for about a share of the keys, else `validation`."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000), "train").otherwise("validation")


def parity(results: dict[str, float], frozen: dict[str, float], tolerance: float = 1e-6) -> list[str]:
    """What differs from frozen figures; a warning for the caller, no error."""
    return [f"{k}: {results.get(k)} is not {v}" for k, v in frozen.items() if k not in results or abs(results[k] - v) > tolerance]
