"""Pluggable encoders and pair scorers, with resumable caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.versions import pending


def signature(*parts: object) -> str:
    """Names what an encoding depends on; vectors of another signature are never reused."""
    import hashlib

    return hashlib.sha256("\0".join(map(repr, parts)).encode()).hexdigest()


def encoder(make: Callable[[], Callable[[list[str]], list]], batch: int = 64):
    """A column function text -> array<float>. make() loads the model once a worker; longest texts go first in a batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            order = texts.fillna("").str.len().sort_values(ascending=False, kind="stable").index
            out: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                for i, vec in zip(chosen, model([texts[i] or "" for i in chosen]), strict=True):
                    out[i] = vec
            yield pd.Series(out)

    return run


def pair_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A column function (query, document) -> double."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in batches:
            yield pd.Series(model(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype=float)

    return run


def encode_missing(texts: DataFrame, cache: DataFrame, encode, sig: str, *key: str) -> DataFrame:
    """Rows to append to a cache (key, sig, vec): encodings of texts that it doesn't hold under this signature."""
    left = pending(texts, cache.where(F.col("sig") == sig).select(*key), *key)
    return left.select(*key, F.lit(sig).alias("sig"), encode(F.col("text")).alias("vec"))


def score_missing(pairs: DataFrame, cache: DataFrame, score, sig: str, *key: str) -> DataFrame:
    """Rows to append to a cache of pair scores (key, sig, score): those of (key, query, code) that it doesn't hold under this signature."""
    left = pending(pairs, cache.where(F.col("sig") == sig).select(*key), *key)
    return left.select(*key, F.lit(sig).alias("sig"), score(F.col("query"), F.col("code")).alias("score"))


def score_in_steps(pairs: DataFrame, path: str, score, sig: str, *key: str, steps: int = 8) -> int:
    """Score what the cache at path lacks and append it, a share of the keys a step; the number of steps that had work.

    A run that is cut short loses one step at most, and the next one goes on where it ended.
    """
    spark = pairs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", sig string, score double"
    done = 0
    for step in range(steps):
        share = pairs.where(F.pmod(F.xxhash64(*key), F.lit(steps)) == step)
        try:
            cache = spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], schema)
        new = score_missing(share, cache, score, sig, *key)
        if not pending(share, cache.where(F.col("sig") == sig).select(*key), *key).isEmpty():
            new.write.mode("append").parquet(path)
            done += 1
    return done
