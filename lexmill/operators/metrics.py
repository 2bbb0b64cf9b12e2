"""Ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.scores import RANK_EDGES, discount, numbered, rank_bucket

DEPTHS = (5, 10, 15, 20, 30, 50, 100)
CUTS = (1, 3, 5, 10, 20, 100)


def strict_rank(scored: DataFrame, relevant: DataFrame, score: str = "score") -> DataFrame:
    """qid, doc_id, rank: one more than the documents that score strictly higher than the relevant one."""
    goal = scored.join(relevant, ["qid", "doc_id"]).select("qid", F.col("doc_id").alias("goal"), F.col(score).alias("goal_score"))
    return scored.join(goal, "qid").groupBy("qid", F.col("goal").alias("doc_id")).agg((F.count_if(F.col(score) > F.col("goal_score")) + 1).alias("rank"))


def with_missing(ranked: DataFrame, queries: DataFrame, depth: int = 100) -> DataFrame:
    """qid, rank for every query: one whose relevant document isn't among the first `depth` counts as rank depth + 1."""
    inside = ranked.where(F.col("rank") <= depth).select("qid", F.col("rank").cast("long").alias("rank"))
    return queries.select("qid").distinct().join(inside, "qid", "left").select("qid", F.coalesce("rank", F.lit(depth + 1).cast("long")).alias("rank"))


def single_relevant(ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row: means over queries of NDCG@k, reciprocal rank, recall@k and rank 1, one relevant document each."""
    inside = F.col("rank") <= k
    return ranked.agg(F.avg(F.when(inside, discount(F.col("rank"))).otherwise(0.0)).alias("ndcg"), F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"), F.avg(F.when(inside, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr_at_k"), F.avg(inside.cast("double")).alias("recall"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1"))


def buckets(ranked: DataFrame, edges: tuple[int, ...] = RANK_EDGES) -> DataFrame:
    return ranked.groupBy(rank_bucket(F.col("rank"), edges).alias("bucket")).agg(F.count("*").alias("n"))


def recall_by_depth(ranked: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    depth = F.explode(F.array(*(F.lit(d) for d in depths))).alias("depth")
    return ranked.select("rank", depth).groupBy("depth").agg(F.avg((F.col("rank") <= F.col("depth")).cast("double")).alias("recall"))


def summary(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.median("rank").alias("median_rank"), F.avg("rank").alias("mean_rank"), F.max("rank").alias("max_rank"))


def graded(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid and its graded NDCG@k, reciprocal rank, recall@k, precision@k, hit, average precision.

    run: qid, doc_id, rank; qrels: qid, doc_id, rel (above 0: relevant). Every query with a relevance
    counts; one without relevant documents has 0 throughout. Average precision divides by
    the smaller of k and the number of relevant documents.
    """
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    ideal = qrels.withColumn("place", F.row_number().over(order)).groupBy("qid").agg(F.sum(F.when(F.col("place") <= k, gain * discount(F.col("place"))).otherwise(0.0)).alias("ideal"), F.count_if(F.col("rel") > 0).alias("relevant"))
    hits = run.where(F.col("rank") <= k).join(qrels.where("rel > 0"), ["qid", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    per = hits.groupBy("qid").agg(F.sum(gain * discount(F.col("rank"))).alias("dcg"), F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(per, "qid", "left").select(
        "qid",
        zero(F.try_divide(F.col("dcg"), F.col("ideal"))).alias("ndcg"),
        zero(F.lit(1.0) / F.col("first")).alias("mrr"),
        zero(F.try_divide(F.col("found"), F.col("relevant"))).alias("recall"),
        zero(F.col("found") / F.lit(float(k))).alias("precision"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        zero(F.try_divide(F.col("precisions"), F.least("relevant", F.lit(k)))).alias("ap"),
    )


def family(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """k, and means over queries of NDCG, MAP, recall, precision, MRR and hit rate at it, for every cut in one pass.

    As graded(), but average precision divides by the number of relevant documents, whatever the cut.
    """
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    k = F.explode(F.array(*(F.lit(c) for c in cuts))).alias("k")
    ideal = qrels.withColumn("place", F.row_number().over(order)).select("*", k)
    ideal = ideal.groupBy("qid", "k").agg(F.sum(F.when(F.col("place") <= F.col("k"), gain * discount(F.col("place"))).otherwise(0.0)).alias("ideal"), F.count_if(F.col("rel") > 0).alias("relevant"))
    hits = run.where(F.col("rank") <= max(cuts)).join(qrels.where("rel > 0"), ["qid", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).select("*", k).where("rank <= k")
    per = hits.groupBy("qid", "k").agg(F.sum(gain * discount(F.col("rank"))).alias("dcg"), F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precisions"))
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return ideal.join(per, ["qid", "k"], "left").groupBy("k").agg(
        zero(F.try_divide(F.col("dcg"), F.col("ideal"))).alias("ndcg"),
        zero(F.try_divide(F.col("precisions"), F.col("relevant"))).alias("map"),
        zero(F.try_divide(F.col("found"), F.col("relevant"))).alias("recall"),
        zero(F.col("found") / F.col("k")).alias("precision"),
        zero(F.lit(1.0) / F.col("first")).alias("mrr"),
        F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def capture(ranked: DataFrame, margin: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5), pairs_per_second: float = 8.16, depth: int = 20) -> DataFrame:
    """What gating the lowest-margin share of queries captures: misses at 1 and at 10, ranks 11 to 20, and reranking time."""
    both = ranked.join(margin, "qid").select("qid", "rank", "margin")
    placed = numbered(both, "margin", "qid").crossJoin(F.broadcast(both.agg(F.count("*").alias("n"))))
    share = placed.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    inside = F.col("place") <= F.floor(F.col("n") * F.col("share"))
    count = lambda c: F.count_if(inside & c)
    return share.groupBy("share").agg(count(F.lit(True)).alias("gated"), count(F.col("rank") > 1).alias("not_first"), count(F.col("rank") > 10).alias("beyond_10"), count(F.col("rank").between(11, 20)).alias("from_11_to_20"), (count(F.lit(True)) * depth / F.lit(pairs_per_second)).alias("seconds"))


def bootstrap(deltas: DataFrame, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """Mean of paired differences (qid, delta) with a 95 % interval from Poisson resamples; a task sends a row of sums a round.

    How often a round draws a query follows from a hash of both, so results repeat, and ids of any kind do.
    """
    import numpy as np
    import pyarrow as pa

    chance = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], float))

    def spread(x):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches):
        total, weight = np.zeros(rounds), np.zeros(rounds)
        salt = spread(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            keys, value = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(keys), 1000):
                even = (spread(spread(keys[at : at + 1000])[:, None] ^ salt) >> np.uint64(11)).astype(float) / (1 << 53)
                draws = np.searchsorted(chance, even).astype(float)
                total += value[at : at + 1000] @ draws
                weight += draws.sum(0)
        yield pa.RecordBatch.from_pydict({"round": pa.array(np.arange(rounds), pa.int32()), "total": total, "weight": weight})

    rows = deltas.where("delta IS NOT NULL").select(F.xxhash64(F.lit(seed), "qid").alias("key"), F.col("delta").cast("double").alias("delta"))
    means = rows.mapInArrow(run, "round int, total double, weight double").groupBy("round").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def accepted(interval: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Adds accepted: a candidate is promoted if its interval lies above 0 and its reciprocal ranks at 100 (rank) don't fall on average."""
    mrr = lambda d, name: d.agg(F.avg(F.when(F.col("rank") <= 100, F.lit(1.0) / F.col("rank")).otherwise(0.0)).alias(name))
    both = interval.crossJoin(F.broadcast(mrr(before, "mrr_before"))).crossJoin(F.broadcast(mrr(after, "mrr_after")))
    return both.withColumn("accepted", (F.col("low") > 0) & (F.col("mrr_after") >= F.col("mrr_before")))
