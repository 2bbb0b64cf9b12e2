"""Fusion of rankings, confidence gating and score blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.scores import by_score, numbered, reciprocal_rank, standardize, weighted


def fuse(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score: the weighted sum of standardised scores, all documents of a query counted."""
    names = list(weights)
    return standardize(scored, names).withColumn("score", weighted([F.col(f"z_{c}") for c in names], list(weights.values())))


def structural_fusion(scored: DataFrame, base: dict[str, float], signature: str, share: float) -> DataFrame:
    """The fused score standardised once more, blended with a standardised signature score."""
    fused = standardize(fuse(scored, base).withColumnRenamed("score", "fused"), ["fused"]).drop(*(f"z_{c}" for c in base))
    return standardize(fused, [signature]).withColumn("score", weighted([F.col("z_fused"), F.col(f"z_{signature}")], [1 - share, share]))


def weight_grid(standard: DataFrame, first: str, second: str, weights: list[float]) -> DataFrame:
    """Every row once a weight: weight * first + (1 - weight) * second."""
    w = F.explode(F.array(*(F.lit(float(x)) for x in weights)))
    return standard.withColumn("weight", w).withColumn("score", F.col("weight") * F.col(first) + (F.lit(1.0) - F.col("weight")) * F.col(second))


def ranks(scored: DataFrame, columns: list[str], tie: str = "doc_id", by: str = "qid") -> DataFrame:
    """rank_<column> from 1 by falling score, ties by id."""
    for c in columns:
        scored = scored.withColumn(f"rank_{c}", F.row_number().over(by_score(c, tie, by=by)))
    return scored


def reciprocal_rank_fusion(ranked: DataFrame, weights: dict[str, float], constant: int = 60) -> DataFrame:
    return ranked.withColumn("score", weighted([reciprocal_rank(F.col(f"rank_{c}"), constant) for c in weights], list(weights.values())))


def reach(weights: list[float], depth: int, constant: int = 60, digits: int = 9) -> int:
    """How far down each ranking the `depth` best of a reciprocal rank fusion can lie: below that in all of them, a document scores less by more than rounding moves it.

    The first `depth` of a ranking have at least its weight over constant + depth each; one beyond place r in all has less than all weights over constant + r.
    """
    if min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be at least 0, and one above it")
    least = max(weights) / (constant + depth) - 2 * 10.0**-digits
    if least <= 0:
        raise ValueError("scores this small are all equal once rounded")
    return max(depth, int(sum(weights) / least) - constant + 1)


def margins(scored: DataFrame, score: str = "score", by: str = "qid") -> DataFrame:
    """qid, margin: the best score less the second best; a query with one document has no margin."""
    best = scored.withColumn("rank", F.row_number().over(by_score(score, by=by))).where("rank <= 2")
    return best.groupBy(by).agg(F.when(F.count("*") == 2, F.max(score) - F.min(score)).alias("margin"))


def threshold(margin: DataFrame, share: float = 0.3) -> DataFrame:
    """One row: the exact percentile of the margins, linearly interpolated between the two at its place."""
    there = margin.where("margin IS NOT NULL")
    total = there.agg(F.count("*").alias("_total"))
    at = F.lit(share) * (F.col("_total") - 1)
    ends = numbered(there, "margin", "qid").crossJoin(F.broadcast(total)).where(F.col("place").between(F.floor(at) + 1, F.ceil(at) + 1))
    low, high = F.min("margin"), F.max("margin")
    part = F.max(at - F.floor(at))
    return ends.agg((low + (high - low) * part).alias("threshold"))


def gate(margin: DataFrame, limit: float | None = None, share: float = 0.3) -> DataFrame:
    """Adds gated: whether a margin is at most the limit, or the percentile if none is given."""
    if limit is not None:
        return margin.withColumn("gated", F.col("margin") <= F.lit(limit))
    return margin.crossJoin(F.broadcast(threshold(margin, share))).withColumn("gated", F.col("margin") <= F.col("threshold")).drop("threshold")


def lowest_share(margin: DataFrame, share: float = 0.3, by: str = "qid") -> DataFrame:
    """The int(n * share) queries with the smallest margins."""
    there = margin.where("margin IS NOT NULL")
    total = there.agg(F.count("*").alias("_total"))
    return numbered(there, "margin", by).crossJoin(F.broadcast(total)).where(F.col("place") <= F.floor(F.col("_total") * F.lit(share))).drop("place", "_total")


def rerank(ranked: DataFrame, second: str, gated: DataFrame, depth: int = 20, blend: float = 0.2, tie: str = "doc_id", by: str = "qid") -> DataFrame:
    """Adds new_rank: within the first `depth` places of gated queries by a blend of both scores, elsewhere as before.

    Only the head is standardised, by the guarded form, and `score` stays the first score.
    """
    head = ranked.where(F.col("rank") <= depth).join(gated.where("gated").select(by), by, "left_semi")
    blended = standardize(head, ["score", second], by, guarded=True)
    blended = blended.withColumn("blended", weighted([F.col("z_score"), F.col(f"z_{second}")], [1 - blend, blend]))
    order = Window.partitionBy(by).orderBy(F.round("blended", 9).desc(), "rank")
    placed = blended.select(by, tie, F.row_number().over(order).alias("new_rank"))
    return ranked.join(placed, [by, tie], "left").withColumn("new_rank", F.coalesce("new_rank", "rank"))


def argmax(grid: DataFrame, what: str, *by: str) -> DataFrame:
    """The row with the greatest (by...) of all, smallest `what` among equals, as one row."""
    return grid.orderBy(*(F.col(c).desc() for c in by), what).limit(1)


def features(ranked: DataFrame, margin: DataFrame, first: str, second: str, text: DataFrame | None = None) -> DataFrame:
    """The eleven features of a learned fusion: both standard scores, fused, their difference, its size, product, discount, log1p of the query's words, three margins.

    margin: qid, margin, and margin_<first>, margin_<second> where the models' own are wanted. A query without a text has no words.
    """
    z1, z2 = F.col(f"z_{first}"), F.col(f"z_{second}")
    out = ranked.join(margin, "qid")
    if text is not None:
        words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
        out = out.join(text.select("qid", "text"), "qid", "left").withColumn("log_words", F.log1p(F.coalesce(F.when(F.col("text").isNotNull(), words), F.lit(0)).cast("double"))).drop("text")
    return out.withColumns({"difference": z1 - z2, "distance": F.abs(z1 - z2), "product": z1 * z2, "discount": F.lit(1.0) / F.log2(F.col("rank") + 1)})
