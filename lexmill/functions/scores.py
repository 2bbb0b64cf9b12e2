"""Score columns: standardisation, fusion, ranks, discounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 1e-8


def standardize(scores: DataFrame, columns: list[str], by: str = "qid", guarded: bool = False) -> DataFrame:
    """Adds z_<column>: each score less the mean of its group, over the population deviation.

    The plain form adds a small constant to the deviation; the guarded one gives 0 where the
    deviation is below it. Statistics are aggregated with map-side sums and joined back, so no
    task holds all rows of a group.
    """
    stats = scores.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    joined = scores.join(stats, by)
    for c in columns:
        centred, deviation = F.col(c) - F.col(f"mean_{c}"), F.col(f"dev_{c}")
        z = F.when(deviation < EPSILON, F.lit(0.0)).otherwise(F.try_divide(centred, deviation)) if guarded else centred / (deviation + EPSILON)
        joined = joined.withColumn(f"z_{c}", z)
    return joined.drop(*(f"{n}_{c}" for c in columns for n in ("mean", "dev")))


def weighted(columns: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def by_score(score: Column | str, *ties: str, by: str = "qid") -> WindowSpec:
    """Rows of a query, best first; equal scores by the tie columns."""
    return Window.partitionBy(by).orderBy(F.col(score).desc() if isinstance(score, str) else score.desc(), *ties)


def reciprocal_rank(rank: Column, constant: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(constant) + rank)


def discount(rank: Column) -> Column:
    """1 / log2(rank + 1)."""
    return F.lit(1.0) / F.log2(rank + 1)


#: Last ranks of the buckets that reports use.
RANK_EDGES, FAILURE_EDGES = (1, 3, 5, 10, 20, 50, 100), (1, 5, 10, 20, 100)


def rank_bucket(rank: Column, edges: tuple[int, ...] = RANK_EDGES) -> Column:
    """1, 2-3, ... and >100."""
    named = [(e, str(e) if e == low + 1 else f"{low + 1}-{e}") for low, e in zip((0, *edges), edges, strict=False)]
    return reduce(lambda c, e: c.when(rank <= e[0], e[1]), named[1:], F.when(rank <= named[0][0], named[0][1])).otherwise(f">{edges[-1]}")


def numbered(df: DataFrame, column: str, tie: str, name: str = "place", buckets: int = 64) -> DataFrame:
    """Adds the rows' numbers from 1 in the order of the column and the tie, without gathering them in one task.

    Approximate quantiles, a row of `buckets` numbers, cut the rows into buckets, which are numbered side by side; the counts of those before are added.
    """
    cuts = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(column))), F.lit(0))).drop("_cuts")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    base = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(column, tie))
    return placed.withColumn("_nth", within).join(F.broadcast(base), "_bucket").withColumn(name, F.col("_base") + F.col("_nth")).drop("_bucket", "_nth", "_base")
