"""Registered queries of the retrieval engine, each with DuckDB SQL for the same rows.

Vectors: `embeddings`, dimensions 1-40 as model a, 41-64 as model b, 1-16 as a third score c;
queries are the vectors whose id is divisible by 100, against all vectors. Relevant is what has
the query's label. Texts: `benchmark` items as queries against `documents`. Versions:
`conversations`, a conversation's turns as versions. Code and questions: one a row of
`part`, made from its number, so that SQL can say what the parser must find.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import code as code_functions
from lexmill.operators import code_reports
from lexmill.functions.scores import FAILURE_EDGES, discount, reciprocal_rank, standardize
from lexmill.functions.text import code_tokens, identifier_words, jaccard, preview, query_terms, short_fingerprint, text_fingerprint, token_set
from lexmill.operators import dense, fusion, lexical, metrics, router, symbolic, validation, versions

PARTS = {"a": (0, 40), "b": (40, 64), "c": (0, 16)}
WEIGHTS = {"a": 0.65, "b": 0.35}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- dense scores and fusion


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and all documents."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return e.where("id % 100 = 0"), e


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.scores(*vectors(spark, sf_dir), PARTS, "id", "id")


def head(spark: SparkSession, sf_dir: str, depth: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The first `depth` documents of each query, with all scores; the rest are never rows."""
    return dense.fused_head(*vectors(spark, sf_dir), PARTS, weights or WEIGHTS, depth, "id", "id")


def best(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return head(spark, sf_dir, depth).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest id above each query's with its label: one relevant document a query."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label").where("vec_id IS NOT NULL AND label IS NOT NULL").distinct()
    after = e.withColumn("doc_id", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")))
    return after.where("vec_id % 100 = 0 AND doc_id IS NOT NULL").groupBy(F.col("vec_id").alias("qid")).agg(F.min("doc_id").alias("doc_id"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    return q.join(e, "label").where("vec_id <> qid").select("qid", F.col("vec_id").alias("doc_id"), (F.lit(1) + (F.col("vec_id") % 3)).cast("int").alias("rel"))


S = """e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings),
s AS (SELECT q.vec_id qid, d.vec_id doc_id, list_dot_product(q.v[1:40], d.v[1:40]) a, list_dot_product(q.v[41:64], d.v[41:64]) b, list_dot_product(q.v[1:16], d.v[1:16]) c
 FROM e q, e d WHERE q.vec_id % 100 = 0)"""
Z = S + """, z AS (SELECT *, (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8) za, (b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-8) zb FROM s WINDOW w AS (PARTITION BY qid)),
f AS (SELECT *, round(0.65 * za + 0.35 * zb, 6) score FROM z)"""
R = Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) rank FROM f)"
REL = "rel AS (SELECT q.vec_id qid, min(d.vec_id) doc_id FROM e q JOIN e d ON q.label = d.label AND d.vec_id > q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1)"
QRELS = "qr AS (SELECT q.vec_id qid, d.vec_id doc_id, 1 + d.vec_id % 3 rel FROM e q JOIN e d ON q.label = d.label AND d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"
STRICT = R + ", " + REL + ", sr AS (SELECT f.qid, g.doc_id, count(*) FILTER (f.score > g.score) + 1 rank FROM f JOIN (SELECT f.qid, f.doc_id, f.score FROM f JOIN rel USING (qid, doc_id)) g USING (qid) GROUP BY 1, 2)"
MARGIN = R + ", m AS (SELECT qid, round(max(score) - min(score), 6) margin FROM r WHERE rank <= 2 GROUP BY qid)"


@register(f"WITH {S} SELECT qid, doc_id, round(a, 6) a, round(b, 6) b FROM s")
def dense_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("qid", "doc_id", r6("a").alias("a"), r6("b").alias("b"))


@register(f"WITH {S}, t AS (SELECT qid, doc_id, round(a, 6) score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) rank FROM t) SELECT qid, doc_id, score, rank::BIGINT rank FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return head(spark, sf_dir, 10, {"a": 1.0}).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register("SELECT p.vec_id a, n.vec_id b, round(list_dot_product(p.embedding::DOUBLE[], n.embedding::DOUBLE[]) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[]))), 6) cosine FROM embeddings p JOIN embeddings n ON n.vec_id = p.vec_id + 1")
def cosine_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    pairs = e.select(F.col("vec_id").alias("a"), "embedding").join(n, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", r6(dense.cosine(F.col("embedding"), F.col("w"))).alias("cosine"))


@register(f"WITH {Z} SELECT qid, doc_id, round(za, 6) z_a, round(zb, 6) z_b FROM z")
def zscores(spark, sf_dir):
    z = dense.scores(*vectors(spark, sf_dir), {c: PARTS[c] for c in "ab"}, "id", "id", recipe=dense.standard(["a", "b"]), names=["z_a", "z_b"])
    return z.select("qid", "doc_id", r6("z_a").alias("z_a"), r6("z_b").alias("z_b"))


@register(f"WITH {S}, t AS (SELECT qid, doc_id, a, row_number() OVER (PARTITION BY qid ORDER BY round(a, 6) DESC, doc_id) rank FROM s), h AS (SELECT * FROM t WHERE rank <= 20) SELECT qid, doc_id, round(CASE WHEN stddev_pop(a) OVER w < 1e-8 THEN 0 ELSE (a - avg(a) OVER w) / stddev_pop(a) OVER w END, 6) z FROM h WINDOW w AS (PARTITION BY qid)")
def zscore_guarded(spark, sf_dir):
    first = head(spark, sf_dir, 20, {"a": 1.0}).select("qid", "doc_id", "a")
    return standardize(first, ["a"], guarded=True).select("qid", "doc_id", r6("z_a").alias("z"))


@register(f"WITH {R} SELECT qid, doc_id, score, rank::BIGINT rank FROM r WHERE rank <= 10")
def zscore_fusion_topk(spark, sf_dir):
    return best(spark, sf_dir, 10)


GRID = [0.0, 0.25, 0.5, 0.65, 0.75, 1.0]
_GRID_SQL = f"WITH {Z}, {REL}, g AS (SELECT qid, doc_id, w.weight, round(w.weight * za + (1 - w.weight) * zb, 6) score FROM z, (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE weight) w), r AS (SELECT *, row_number() OVER (PARTITION BY weight, qid ORDER BY score DESC, doc_id) rank FROM g), m AS (SELECT weight, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) ndcg, round(avg(1.0 / rank), 6) mrr FROM r JOIN rel USING (qid, doc_id) GROUP BY weight)"


def _grid(spark, sf_dir):
    """The relevant documents' ranks under every weight are counted; no score is a row."""
    found = dense.places(*vectors(spark, sf_dir), {c: PARTS[c] for c in "ab"}, dense.grid("a", "b", GRID), [f"w{i}" for i in range(len(GRID))], relevant(spark, sf_dir), "id", "id")
    rank = lambda i: F.col(f"above_w{i}") + F.col(f"before_w{i}") + 1
    r = found.select(F.inline(F.array(*(F.struct(F.lit(w).alias("weight"), rank(i).alias("rank")) for i, w in enumerate(GRID)))))
    return r.groupBy("weight").agg(r6(F.avg(F.when(F.col("rank") <= 10, discount(F.col("rank"))).otherwise(0.0))).alias("ndcg"), r6(F.avg(F.lit(1.0) / F.col("rank"))).alias("mrr"))


@register(_GRID_SQL + " SELECT weight, ndcg, mrr FROM m")
def fusion_weight_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@register(_GRID_SQL + " SELECT weight, ndcg, mrr FROM m ORDER BY ndcg DESC, mrr DESC, weight LIMIT 1")
def grid_argmax(spark, sf_dir):
    return fusion.argmax(_grid(spark, sf_dir), "weight", "ndcg", "mrr")


_RRF = f"WITH {S}, k AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(a, 6) DESC, doc_id) ra, row_number() OVER (PARTITION BY qid ORDER BY round(b, 6) DESC, doc_id) rb FROM s)"


def _both_ranks(spark, sf_dir, depth):
    """Exact ranks of the documents among the first `depth` by either score."""
    return dense.head_ranks(*vectors(spark, sf_dir), {c: PARTS[c] for c in "ab"}, depth, "id", "id")


@register(_RRF + ", f AS (SELECT qid, doc_id, round(0.65 / (60 + ra) + 0.35 / (60 + rb), 9) score FROM k), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) rank FROM f) SELECT qid, doc_id, score, rank::BIGINT rank FROM t WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    ranked = _both_ranks(spark, sf_dir, fusion.reach(list(WEIGHTS.values()), 10))
    f = fusion.reciprocal_rank_fusion(ranked, WEIGHTS).select("qid", "doc_id", F.round("score", 9).alias("score"))
    return dense.top_k(f, 10).withColumn("rank", F.col("rank").cast("long"))


BETAS = [0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]


@register(_RRF + f", f AS (SELECT qid, doc_id, beta, round(1.0 / (60 + ra) + beta / (60 + rb), 9) score FROM k, (SELECT unnest([{', '.join(map(str, BETAS))}])::DOUBLE beta)) SELECT beta, qid, first(doc_id ORDER BY score DESC, doc_id) doc_id FROM f GROUP BY 1, 2")
def rrf_weight_grid(spark, sf_dir):
    g = _both_ranks(spark, sf_dir, max(fusion.reach([1.0, beta], 1) for beta in BETAS)).withColumn("beta", F.explode(F.array(*map(F.lit, BETAS))))
    g = g.withColumn("score", F.round(reciprocal_rank(F.col("rank_a")) + F.col("beta") * reciprocal_rank(F.col("rank_b")), 9))
    return g.groupBy("beta", "qid").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"))


@register(f"WITH {Z}, g AS (SELECT qid, doc_id, c, 0.65 * za + 0.35 * zb x FROM z), h AS (SELECT qid, doc_id, round(0.8 * (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8) + 0.2 * (c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-8), 6) score FROM g WINDOW w AS (PARTITION BY qid)), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) rank FROM h) SELECT qid, doc_id, score, rank::BIGINT rank FROM t WHERE rank <= 10")
def structural_weight_fusion(spark, sf_dir):
    f = dense.head(*vectors(spark, sf_dir), PARTS, dense.structural(WEIGHTS, "c", 0.2), 10, query_id="id", doc_id="id")
    return f.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- confidence


def _margins(spark, sf_dir):
    return fusion.margins(head(spark, sf_dir, 2)).withColumn("margin", r6("margin")).cache()  # a row a query, read several times


@register(f"WITH {MARGIN} SELECT qid, margin FROM m")
def confidence_margin(spark, sf_dir):
    return _margins(spark, sf_dir)


@register(f"WITH {MARGIN} SELECT round(quantile_cont(margin, 0.3), 6) threshold FROM m")
def confidence_threshold(spark, sf_dir):
    return fusion.threshold(_margins(spark, sf_dir)).select(r6("threshold").alias("threshold"))


@register(f"WITH {MARGIN} SELECT qid, margin, margin <= (SELECT quantile_cont(margin, 0.3) FROM m) gated FROM m")
def confidence_gate(spark, sf_dir):
    return fusion.gate(_margins(spark, sf_dir))


@register(f"WITH {MARGIN} SELECT qid, margin FROM m ORDER BY margin, qid LIMIT (SELECT floor(count(*) * 0.3)::BIGINT FROM m)")
def fraction_gate(spark, sf_dir):
    return fusion.lowest_share(_margins(spark, sf_dir))


@register(f"WITH {MARGIN}, g AS (SELECT qid FROM m WHERE margin <= (SELECT quantile_cont(margin, 0.5) FROM m)), h AS (SELECT r.* FROM r JOIN g USING (qid) WHERE rank <= 20), b AS (SELECT qid, doc_id, rank, 0.8 * (score - avg(score) OVER w) / stddev_pop(score) OVER w + 0.2 * (c - avg(c) OVER w) / stddev_pop(c) OVER w x FROM h WINDOW w AS (PARTITION BY qid)), n AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, rank) new_rank FROM b) SELECT r.qid, r.doc_id, r.score, r.rank::BIGINT rank, coalesce(n.new_rank, r.rank)::BIGINT new_rank FROM r LEFT JOIN n USING (qid, doc_id) WHERE r.rank <= 100")
def gated_rerank_blend(spark, sf_dir):
    first = head(spark, sf_dir, 100).cache()  # a hundred rows a query
    margin = first.where("rank <= 2").groupBy("qid").agg(r6(F.when(F.count("*") == 2, F.max("score") - F.min("score"))).alias("margin")).cache()
    out = fusion.rerank(first, "c", fusion.gate(margin, share=0.5))
    return out.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


_OWN = ", ".join(f"o{c} AS (SELECT qid, round(max(x) - min(x), 6) margin_{c} FROM (SELECT qid, round(z{c}, 6) x, row_number() OVER (PARTITION BY qid ORDER BY round(z{c}, 6) DESC, doc_id) n FROM z) WHERE n <= 2 GROUP BY 1)" for c in "ab")
_WORDS = "t AS (SELECT doc_id qid, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) words FROM documents)"


@register(f"WITH {MARGIN}, {_OWN}, {_WORDS} SELECT qid, doc_id, round(za, 6) z_a, round(zb, 6) z_b, score, round(za - zb, 6) difference, round(abs(za - zb), 6) distance, round(za * zb, 6) product, round(1 / log2(rank + 1), 6) discount, round(ln(1 + coalesce(words, 0)), 6) log_words, margin, margin_a, margin_b FROM r JOIN m USING (qid) JOIN oa USING (qid) JOIN ob USING (qid) LEFT JOIN t USING (qid) WHERE rank <= 20")
def fusion_features(spark, sf_dir):
    """All eleven; a query's text is the document of its number."""
    own = [fusion.margins(head(spark, sf_dir, 2, {"a": a, "b": 1 - a})).select("qid", r6("margin").alias(f"margin_{c}")) for c, a in (("a", 1.0), ("b", 0.0))]
    margin = _margins(spark, sf_dir).join(own[0], "qid").join(own[1], "qid")
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text")
    f = fusion.features(head(spark, sf_dir, 20), margin, "a", "b", text)
    return f.select("qid", "doc_id", *(r6(c).alias(c) for c in ("z_a", "z_b", "score", "difference", "distance", "product", "discount", "log_words", "margin", "margin_a", "margin_b")))


# ---------------------------------------------------------------- ranking quality


def _strict(spark, sf_dir):
    """Documents that score strictly higher are counted where they lie."""
    found = dense.places(*vectors(spark, sf_dir), {c: PARTS[c] for c in WEIGHTS}, dense.fused(WEIGHTS), ["score"], relevant(spark, sf_dir), "id", "id")
    return found.select("qid", "doc_id", (F.col("above_score") + 1).alias("rank"))


@register(f"WITH {STRICT} SELECT qid, doc_id, rank::BIGINT rank FROM sr")
def rank_strict_count(spark, sf_dir):
    return _strict(spark, sf_dir)


@register(f"WITH {STRICT} SELECT CASE WHEN rank <= 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 5 THEN '4-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' WHEN rank <= 100 THEN '51-100' ELSE '>100' END bucket, count(*) n FROM sr GROUP BY 1")
def rank_buckets(spark, sf_dir):
    return metrics.buckets(_strict(spark, sf_dir))


@register(f"WITH {STRICT} SELECT CASE WHEN rank <= 1 THEN '1' WHEN rank <= 5 THEN '2-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 100 THEN '21-100' ELSE '>100' END bucket, count(*) n FROM sr GROUP BY 1")
def failure_buckets(spark, sf_dir):
    return metrics.buckets(_strict(spark, sf_dir), FAILURE_EDGES)


@register(f"WITH {STRICT}, a AS (SELECT vec_id qid FROM embeddings WHERE vec_id % 100 = 0), g AS (SELECT qid, CASE WHEN rank <= 100 THEN rank ELSE 101 END rank FROM a LEFT JOIN sr USING (qid)) SELECT round(avg((rank = 1)::INT), 6) rank1, round(avg(CASE WHEN rank <= 100 THEN 1.0 / rank ELSE 0 END), 6) mrr_at_100, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) ndcg, round(avg(rank), 6) mean_rank, count(*) FILTER (rank = 101) missing FROM g")
def missing_as_101(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"))
    g = metrics.with_missing(_strict(spark, sf_dir), e)
    m = metrics.single_relevant(g, 10).select("ndcg", "rank1").crossJoin(g.agg(F.avg(F.when(F.col("rank") <= 100, F.lit(1.0) / F.col("rank")).otherwise(0.0)).alias("mrr_at_100"), F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") == 101).alias("missing")))
    return m.select(r6("rank1").alias("rank1"), r6("mrr_at_100").alias("mrr_at_100"), r6("ndcg").alias("ndcg"), r6("mean_rank").alias("mean_rank"), "missing")


@register(f"WITH {STRICT} SELECT d.depth, round(avg((rank <= d.depth)::INT), 6) recall FROM sr, (SELECT unnest([5, 10, 15, 20, 30, 50, 100])::INT depth) d GROUP BY 1")
def recall_by_depth(spark, sf_dir):
    return metrics.recall_by_depth(_strict(spark, sf_dir)).select("depth", r6("recall").alias("recall"))


@register(f"WITH {STRICT} SELECT median(rank)::DOUBLE median_rank, round(avg(rank), 6) mean_rank, max(rank)::BIGINT max_rank FROM sr")
def rank_summary(spark, sf_dir):
    return metrics.summary(_strict(spark, sf_dir)).withColumn("mean_rank", r6("mean_rank"))


@register(f"WITH {STRICT} SELECT round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) ndcg, round(avg(1.0 / rank), 6) mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) mrr_at_k, round(avg((rank <= 10)::INT), 6) recall, round(avg((rank = 1)::INT), 6) rank1 FROM sr")
def ndcg_mrr_recall(spark, sf_dir):
    m = metrics.single_relevant(_strict(spark, sf_dir))
    return m.select(*(r6(c).alias(c) for c in m.columns))


_GRADED = f"""WITH {R}, {QRELS}, run AS (SELECT * FROM r WHERE doc_id <> qid),
rr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) rank FROM run),
i AS (SELECT qid, sum(CASE WHEN p <= 10 THEN (pow(2, rel) - 1) / log2(p + 1) ELSE 0 END) ideal, count(*) relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) p FROM qr) GROUP BY 1),
h AS (SELECT rr.qid, rr.rank, qr.rel, row_number() OVER (PARTITION BY rr.qid ORDER BY rr.rank) nth FROM rr JOIN qr USING (qid, doc_id) WHERE rr.rank <= 10),
p AS (SELECT qid, sum((pow(2, rel) - 1) / log2(rank + 1)) dcg, count(*) found, min(rank) first, sum(nth / rank) precisions FROM h GROUP BY 1)"""


def _graded(spark, sf_dir):
    return metrics.graded(_others(spark, sf_dir, 10), qrels(spark, sf_dir))


def _others(spark, sf_dir, depth):
    """The first documents besides the query itself."""
    return best(spark, sf_dir, depth + 1).where("doc_id <> qid").select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank")).where(F.col("rank") <= depth)


_FAMILY = f"""WITH {R}, {QRELS}, rr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) rank FROM r WHERE doc_id <> qid), ks AS (SELECT unnest([1, 3, 5, 10, 20, 100])::INT k),
i AS (SELECT qid, k, sum(CASE WHEN p <= k THEN (pow(2, rel) - 1) / log2(p + 1) ELSE 0 END) ideal, count(*) relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) p FROM qr), ks GROUP BY 1, 2),
h AS (SELECT rr.qid, rr.rank, qr.rel, row_number() OVER (PARTITION BY rr.qid ORDER BY rr.rank) nth FROM rr JOIN qr USING (qid, doc_id)),
p AS (SELECT qid, k, sum((pow(2, rel) - 1) / log2(rank + 1)) dcg, count(*) found, min(rank) first, sum(nth / rank) precisions FROM h, ks WHERE rank <= k GROUP BY 1, 2)
SELECT k, round(avg(coalesce(dcg / ideal, 0)), 6) ndcg, round(avg(coalesce(precisions / relevant, 0)), 6) AS "map", round(avg(coalesce(found / relevant, 0)), 6) recall, round(avg(coalesce(found / k, 0)), 6) AS "precision", round(avg(coalesce(1.0 / first, 0)), 6) mrr, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0 END), 6) hit_rate FROM i LEFT JOIN p USING (qid, k) GROUP BY 1"""


@register(_FAMILY)
def metric_family(spark, sf_dir):
    m = metrics.family(_others(spark, sf_dir, 100), qrels(spark, sf_dir))
    return m.select("k", *(r6(c).alias(c) for c in ("ndcg", "map", "recall", "precision", "mrr", "hit_rate")))


@register(_GRADED + " SELECT i.qid, round(coalesce(dcg / ideal, 0), 6) ndcg, round(coalesce(1.0 / first, 0), 6) mrr FROM i LEFT JOIN p USING (qid)")
def graded_ndcg(spark, sf_dir):
    return _graded(spark, sf_dir).select("qid", r6("ndcg").alias("ndcg"), r6("mrr").alias("mrr"))


@register(_GRADED + " SELECT i.qid, round(coalesce(precisions / least(relevant, 10), 0), 6) ap, round(coalesce(found / 10, 0), 6) AS precision_at_10, round(coalesce(found / relevant, 0), 6) recall, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END hit FROM i LEFT JOIN p USING (qid)")
def map_precision_hit(spark, sf_dir):
    return _graded(spark, sf_dir).select("qid", r6("ap").alias("ap"), r6("precision").alias("precision_at_10"), r6("recall").alias("recall"), "hit")


@register(f"WITH {STRICT}, m AS (SELECT qid, round(max(score) - min(score), 6) margin FROM r WHERE rank <= 2 GROUP BY qid), p AS (SELECT sr.rank, row_number() OVER (ORDER BY margin, qid) place, count(*) OVER () n FROM sr JOIN m USING (qid)) SELECT s.share, count(*) FILTER (place <= floor(n * s.share)) gated, count(*) FILTER (place <= floor(n * s.share) AND rank > 1) not_first, count(*) FILTER (place <= floor(n * s.share) AND rank > 10) beyond_10, count(*) FILTER (place <= floor(n * s.share) AND rank BETWEEN 11 AND 20) from_11_to_20, round(count(*) FILTER (place <= floor(n * s.share)) * 20 / 8.16, 6) AS seconds FROM p, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE share) s GROUP BY 1")
def gating_capture(spark, sf_dir):
    return metrics.capture(_strict(spark, sf_dir).cache(), _margins(spark, sf_dir)).withColumn("seconds", r6("seconds"))


@register(f"WITH {STRICT} SELECT sr.qid, sr.doc_id, sr.rank::BIGINT rank, list(r.doc_id ORDER BY r.rank) top3 FROM (SELECT * FROM sr ORDER BY rank DESC, qid LIMIT 5) sr JOIN r ON r.qid = sr.qid AND r.rank <= 3 GROUP BY 1, 2, 3")
def worst_failures(spark, sf_dir):
    worst = _strict(spark, sf_dir).orderBy(F.desc("rank"), "qid").limit(5)
    top = best(spark, sf_dir, 3).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top3"))
    return worst.join(top, "qid")


@register()
def paired_bootstrap(spark, sf_dir):
    """Of the fused against the first model's reciprocal ranks; random, so without SQL."""
    both = dense.together(dense.product("a", "before"), dense.fused(WEIGHTS, "after"))
    found = dense.places(*vectors(spark, sf_dir), {c: PARTS[c] for c in WEIGHTS}, both, ["before", "after"], relevant(spark, sf_dir), "id", "id").cache()  # a row a query, read several times
    before, after = (found.select("qid", (F.col(f"above_{c}") + 1).alias("rank")) for c in ("before", "after"))
    gain = lambda d, name: d.select("qid", (F.lit(1.0) / F.col("rank")).alias(name))
    deltas = gain(before, "x").join(gain(after, "y"), "qid").select("qid", (F.col("y") - F.col("x")).alias("delta"))
    return metrics.accepted(metrics.bootstrap(deltas), before, after)


@register(f"WITH {R} SELECT qid, list(doc_id ORDER BY rank) docs FROM r WHERE rank <= 100 GROUP BY qid")
def ranking_export(spark, sf_dir):
    from lexmill.sources.io import export_rankings

    return export_rankings(head(spark, sf_dir, 100)).select("qid", "docs")


# ---------------------------------------------------------------- texts

PATTERN = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+|==|!=|<=|>=|//|\\*\\*|[+\\-*/%<>]"
TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{PATTERN}')"


@register(f"SELECT doc_id, len({TOKENS})::BIGINT n_tokens, len(list_distinct({TOKENS}))::BIGINT n_distinct, {TOKENS}[1:5] first_tokens FROM documents")
def code_token_counts(spark, sf_dir):
    t = code_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(token_set(F.col("text"))).cast("long").alias("n_distinct"), F.slice(t, 1, 5).alias("first_tokens"))


_BM25 = f"""WITH t AS (SELECT doc_id, {TOKENS} toks FROM documents), l AS (SELECT doc_id, len(toks) dl FROM t),
c AS (SELECT doc_id, token, count(*) tf FROM (SELECT doc_id, unnest(toks) token FROM t) GROUP BY 1, 2),
n AS (SELECT count(*) n_docs, avg(dl) avgdl FROM l), d AS (SELECT token, count(*) df FROM c GROUP BY 1),
i AS (SELECT token, ln(n_docs - df + 0.5) - ln(df + 0.5) raw, avgdl FROM d, n), j AS (SELECT token, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END idf FROM i),
q AS (SELECT item_id qid, token, count(*) times FROM (SELECT item_id, unnest({TOKENS}) token FROM benchmark) GROUP BY 1, 2),
b AS (SELECT qid, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score FROM c JOIN j USING (token) JOIN l USING (doc_id) JOIN q USING (token) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) rank FROM b)"""


def _bm25(spark, sf_dir, depth):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return lexical.bm25(q, table(spark, sf_dir, "documents"), depth).withColumn("rank", F.col("rank").cast("long"))


@register(_BM25 + " SELECT qid, doc_id, score, rank::BIGINT rank FROM k WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@register(_BM25 + ", rel AS (SELECT item_id qid, min(doc_id) doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1) SELECT count(*) relevant, count(*) FILTER (k.rank <= 100) within_100, count(*) FILTER (k.rank <= 500) within_500, count(*) FILTER (k.rank IS NULL OR k.rank > 100) missed FROM rel LEFT JOIN k USING (qid, doc_id)")
def bm25_rescues(spark, sf_dir):
    """Where BM25 finds the document that holds a whole item; ranks beyond 500 count as missed."""
    rel = lexical.holders(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), table(spark, sf_dir, "documents"))
    joined = rel.join(_bm25(spark, sf_dir, 500), ["qid", "doc_id"], "left")
    return joined.agg(F.count("*").alias("relevant"), F.count_if(F.col("rank") <= 100).alias("within_100"), F.count_if(F.col("rank") <= 500).alias("within_500"), F.count_if(F.col("rank").isNull() | (F.col("rank") > 100)).alias("missed"))


# Questions, their routes and terms, written out by hand; {} is the number of a part.
ASKED = [
    ("check whether a tic tac toe board state is valid", "semantic", ["check", "whether", "tic", "tac", "toe", "board", "state", "valid"]),
    ("find code that performs binary search{}", "semantic", ["performs", "binary", "search{}"]),
    ("which functions call parse_config{} before save_config{}?", "structural", ["parse_config{}", "save_config{}"]),
    ("find usages of torch.nn.Linear{}", "exact_usage", ["torch.nn.Linear{}"]),
    ("which files import requests{}?", "exact_usage", ["requests{}"]),
    ("find recursive functions that traverse a tree", "structural", ["traverse", "tree"]),
    ("show how this implementation changed between versions", "evolution", []),
    ("find the older implementation of authentication{}", "evolution", ["authentication{}"]),
    ("which classes contain nested loops?", "structural", ["nested", "loops"]),
    ("code that sorts a string according to a custom ordering", "semantic", ["sorts", "string", "according", "custom", "ordering"]),
    ("which files import math?", "exact_usage", ["math"]),
    ("which functions call range before print?", "structural", ["range", "print"]),
    ("show binary search version history", "evolution", ["binary", "search"]),
    ("use a heap{}", "exact_usage", ["heap{}"]),
]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, text: a question a part."""
    p = F.col("p_partkey")
    text = F.element_at(F.array(*(F.lit(t) for t, *_ in ASKED)), (p % len(ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(p.alias("qid"), F.replace(text, F.lit("{}"), p.cast("string")).alias("text"))


def _by_hand(values: list[str]) -> str:
    return "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_TERMS = _by_hand(["[" + ", ".join(f"replace('{t}', '{{}}', p_partkey::VARCHAR)" for t in terms) + "]::VARCHAR[]" for _, _, terms in ASKED])


@register("SELECT p_partkey qid, " + _by_hand([f"'{r}'" for _, r, _ in ASKED]) + " route FROM part")
def route_query(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", router.route(F.col("text")).alias("route"))


@register(f"SELECT p_partkey qid, {_TERMS} terms FROM part")
def query_term_lists(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", query_terms(F.col("text")).alias("terms"))


@register("SELECT p_partkey qid, " + _by_hand([f"'{r}'" for _, r, _ in ASKED]) + " route, " + _by_hand(["0.95" if r == "evolution" else "0.9" for _, r, _ in ASKED]) + f"::DOUBLE confidence, len({_TERMS}) n_terms FROM part")
def query_plans(spark, sf_dir):
    plan = asked(spark, sf_dir).select("qid", router.plan_column(F.col("text")).alias("p"))
    return plan.select("qid", "p.route", "p.confidence", F.size("p.terms").cast("long").alias("n_terms"))


_ITEMS_SQL = "q AS (SELECT item_id qid, text FROM benchmark)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


@register(f"WITH {_ITEMS_SQL} SELECT qid, CASE WHEN regexp_matches(text, '\\b(version|versions|history|changed|change between|changes between|changed between|evolved|previous implementation|older implementation|when was)\\b', 'i') THEN 'evolution' WHEN regexp_matches(text, '\\b(before|after|recursive|recursion|nested loop|nested loops|call graph|dependency graph|sequence of calls)\\b', 'i') OR regexp_matches(text, '\\b(class|classes|function|functions)\\b.*\\bwith\\b', 'i') OR regexp_matches(text, '\\bcontains?\\b.*\\bloop\\b', 'i') THEN 'structural' WHEN regexp_matches(text, '\\b(uses?|calls?|calling|imports?|importing) .?[A-Za-z_]', 'i') OR regexp_matches(text, '\\bwhere is\\b.*\\bused\\b', 'i') THEN 'exact_usage' ELSE 'semantic' END route FROM q")
def route_benchmark(spark, sf_dir):
    return items(spark, sf_dir).select("qid", router.route(F.col("text")).alias("route"))


@register()
def benchmark_term_lists(spark, sf_dir):
    """Without SQL: DuckDB's word boundaries are ASCII only, those of the operator and of Python are not."""
    return items(spark, sf_dir).select("qid", query_terms(F.col("text")).alias("terms"))


# Names, and their words by hand; {} is the number of a part.
NAMES = [("parseConfigFile{}", "parse config file{}"), ("HTTPServer{}", "httpserver{}"), ("snake_case_{}", "snake case {}"), ("x{}Y", "x{} y"), ("__init{}__", "init{}"), ("already  lower{}", "already lower{}"), ("aB{}_cD", "a b{} c d")]


@register("SELECT p_partkey id, replace(CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(NAMES)) + " END, '{}', p_partkey::VARCHAR) words FROM part")
def split_identifiers(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.replace(F.element_at(F.array(*(F.lit(n) for n, _ in NAMES)), (p % len(NAMES) + 1).cast("int")), F.lit("{}"), p.cast("string"))
    return table(spark, sf_dir, "part").select(p.alias("id"), identifier_words(name).alias("words"))


# ---------------------------------------------------------------- versions


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("logical_id"), F.col("turn").alias("version"), F.col("text").alias("code"))


_TOK = TOKENS.replace("text", "code")
VERS = f"""v AS (SELECT conv_id logical_id, turn AS version, text AS code FROM conversations),
w AS (SELECT *, sha256(trim(regexp_replace(coalesce(code, ''), '\\s+', ' ', 'g'))) fingerprint, list_distinct({_TOK}) toks FROM v),
l AS (SELECT *, row_number() OVER o n, lag(toks) OVER o before, lag(fingerprint) OVER o print FROM w WINDOW o AS (PARTITION BY logical_id ORDER BY version, fingerprint)),
j AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN fingerprint = print THEN 1.0 WHEN len(toks) + len(before) = 0 THEN 1.0 ELSE len(list_intersect(toks, before)) / (len(toks) + len(before) - len(list_intersect(toks, before))) END sim FROM l),
c AS (SELECT logical_id, version, fingerprint, sim::DOUBLE previous_similarity, CASE WHEN n = 1 THEN 'initial' WHEN fingerprint = print THEN 'unchanged' WHEN sim >= 0.82 THEN 'near_duplicate_update' ELSE 'substantial_update' END change_type FROM j)"""


@register(f"WITH {VERS} SELECT logical_id, version, fingerprint, round(previous_similarity, 6) previous_similarity, change_type FROM c")
def lineage_changes(spark, sf_dir):
    return versions.changes(turns(spark, sf_dir), "version").select("logical_id", "version", "fingerprint", r6("previous_similarity").alias("previous_similarity"), "change_type")


@register(f"WITH {VERS} SELECT count(DISTINCT logical_id) lineages, count(*) versions, count(*) FILTER (change_type = 'unchanged') unchanged, count(*) FILTER (change_type = 'near_duplicate_update') near_duplicate, count(*) FILTER (change_type = 'substantial_update') substantial FROM c")
def lineage_stats(spark, sf_dir):
    return versions.stats(versions.changes(turns(spark, sf_dir), "version"))


@register("SELECT conv_id logical_id, count(*) version_count, list(turn ORDER BY turn) timeline FROM conversations GROUP BY 1")
def version_history(spark, sf_dir):
    return versions.history(turns(spark, sf_dir), "version").select("logical_id", "version_count", F.transform("timeline", lambda x: x["version"]).alias("timeline"))


_HITS = "h AS (SELECT conv_id logical_id, min(turn) hit_at FROM conversations WHERE turn % 2 = 1 GROUP BY 1)"


def _timeline(spark, sf_dir, truncate):
    t = versions.changes(turns(spark, sf_dir), "version").withColumn("append_seq", F.col("version"))
    hits = t.where("version % 2 = 1").groupBy("logical_id").agg(F.min("append_seq").alias("append_seq"))
    return versions.timeline_until(hits, t, "append_seq", truncate).select("logical_id", "hit_at", "at", "change_type")


@register(f"WITH {VERS}, {_HITS} SELECT logical_id, hit_at, version AS at, change_type FROM h JOIN c USING (logical_id) WHERE version <= hit_at")
def timeline_until_hit(spark, sf_dir):
    return _timeline(spark, sf_dir, True)


@register(f"WITH {VERS}, {_HITS} SELECT logical_id, hit_at, version AS at, change_type FROM h JOIN c USING (logical_id)")
def timeline_whole(spark, sf_dir):
    return _timeline(spark, sf_dir, False)


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn is a commit; a conversation changes in its own turns and is deleted in turn 5 if it has one."""
    v = turns(spark, sf_dir).select(F.col("version").alias("commit_ord"), F.col("logical_id").alias("path"), F.when(F.col("version") != 5, F.col("version")).alias("version"))
    n = v.agg(F.max("commit_ord").alias("last"))
    return v, n.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("commit_ord"))


SNAP = """ev AS (SELECT turn commit_ord, conv_id path, CASE WHEN turn <> 5 THEN turn END AS version FROM conversations),
co AS (SELECT unnest(range(0, (SELECT max(turn) + 1 FROM conversations))) commit_ord),
sp AS (SELECT *, lead(commit_ord) OVER (PARTITION BY path ORDER BY commit_ord) until FROM ev),
sn AS (SELECT co.commit_ord, path, sp.version FROM sp JOIN co ON co.commit_ord >= sp.commit_ord AND (until IS NULL OR co.commit_ord < until) WHERE sp.version IS NOT NULL)"""


@register(f"WITH {SNAP} SELECT commit_ord, path, version FROM sn")
def snapshot_carry_forward(spark, sf_dir):
    return versions.carry_forward(*commits(spark, sf_dir))


def _scope(spark, sf_dir, scope, commit=None, with_snapshots=True):
    snap = versions.carry_forward(*commits(spark, sf_dir)).select("commit_ord", F.col("commit_ord").cast("string").alias("commit"), F.col("path").alias("logical_id"), "version")
    deleted = F.col("version") == 5
    rows = versions.changes(turns(spark, sf_dir), "version", deleted=deleted).withColumn("append_seq", F.col("version"))
    return versions.in_scope(rows, scope, "append_seq", snap if with_snapshots else None, commit).select("logical_id", "version", "change_type")


_LIVE = "SELECT logical_id, c.version, change_type FROM c"


@register(f"WITH {VERS} {_LIVE} WHERE version <> 5")
def version_scope_all(spark, sf_dir):
    return _scope(spark, sf_dir, "all")


@register(f"WITH {VERS}, {SNAP} {_LIVE} JOIN sn ON sn.path = logical_id AND sn.version = c.version WHERE c.version <> 5 AND sn.commit_ord = (SELECT max(commit_ord) FROM sn)")
def version_scope_latest(spark, sf_dir):
    return _scope(spark, sf_dir, "latest")


@register(f"WITH {VERS} {_LIVE} WHERE version <> 5 AND version = (SELECT max(turn) FROM conversations WHERE conv_id = logical_id)")
def version_scope_latest_without_snapshots(spark, sf_dir):
    return _scope(spark, sf_dir, "latest", with_snapshots=False)


@register(f"WITH {VERS}, {SNAP} {_LIVE} JOIN sn ON sn.path = logical_id AND sn.version = c.version WHERE c.version <> 5 AND sn.commit_ord = 2")
def version_scope_commit(spark, sf_dir):
    return _scope(spark, sf_dir, "commit", "2")


@register("WITH t AS (SELECT conv_id, turn FROM conversations) SELECT conv_id logical_id, turn AS version, (turn - 3 + 2)::BIGINT append_seq FROM t WHERE turn >= 3")
def append_idempotent(spark, sf_dir):
    """Turns 0-2 are stored; all turns arrive twice; only the others are appended, numbered on."""
    t = turns(spark, sf_dir)
    stored = t.where("version < 3").withColumn("append_seq", F.col("version") - 1)
    incoming = t.withColumn("arrival", F.col("version")).withColumn("deleted", F.lit(False))
    new = versions.append(stored, incoming.unionByName(incoming.withColumn("arrival", F.col("arrival") + 100)))
    return new.select("logical_id", "version", "append_seq")


@register("SELECT p_partkey logical_id, '2' AS version, CASE p_partkey % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'substantial_update' ELSE 'deleted' END change_type, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(5 / 7, 6) ELSE 0.0 END::DOUBLE previous_similarity, 1::BIGINT append_seq, 'part ' || p_partkey title FROM part UNION ALL SELECT p_partkey, '3', CASE p_partkey % 3 WHEN 1 THEN 'substantial_update' WHEN 2 THEN 'substantial_update' ELSE 'near_duplicate_update' END, CASE p_partkey % 3 WHEN 0 THEN 0.75 WHEN 1 THEN round(5 / 8, 6) ELSE 0.0 END, 2, 'part ' || p_partkey FROM part")
def append_code_versions(spark, sf_dir):
    """A function a part: its second version only has a comment more, adds another number or is deleted; the third adds a name."""
    p = F.col("p_partkey")
    line = lambda n, tail="": F.concat(F.lit("def f(a):\n    return a + "), n.cast("string"), F.lit(tail))
    part = table(spark, sf_dir, "part")
    stored = part.select(p.alias("logical_id"), F.lit("1").alias("version"), line(p).alias("code"), F.lit(0).cast("long").alias("append_seq"))
    second = part.select(p.alias("logical_id"), F.lit("2").alias("version"), F.when(p % 3 == 0, line(p, "  # sum")).when(p % 3 == 1, line(p + 1_000_000)).otherwise(F.lit("")).alias("code"), F.lit(1).alias("arrival"), (p % 3 == 2).alias("deleted"), F.concat(F.lit("part "), p.cast("string")).alias("title"))
    third = second.withColumns({"version": F.lit("3"), "arrival": F.lit(2), "deleted": F.lit(False), "code": line(F.col("logical_id"), " + extra")})
    new = versions.append(stored, second.unionByName(third), fingerprint=code_functions.code_fingerprint)
    return new.select("logical_id", "version", "change_type", r6("previous_similarity").alias("previous_similarity"), "append_seq", "title")


@register("SELECT count(DISTINCT vec_id % 7) lineages, count(*) versions, sum(4 * len(embedding))::BIGINT vector_bytes, max(4 * len(embedding))::INT bytes_per_version FROM embeddings")
def version_storage(spark, sf_dir):
    log = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("logical_id"), F.col("embedding").alias("vec"))
    return versions.storage(log)


@register("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'x' ELSE role END AS role FROM conversations")
def keyed_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return versions.upsert(c, c.where("turn = 0").withColumn("role", F.lit("x")), "conv_id", "turn")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti_join(spark, sf_dir):
    return versions.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SPLIT = "list_filter(list_distinct(string_split({}, ' ')), lambda w: w <> '')"


@register(f"WITH p AS (SELECT p_partkey qid, {_PLAIN.format(chr(39) + 'How has the ' + chr(39) + ' || p_name || ' + chr(39) + ' changed, Brand ' + chr(39) + ' || p_size')} plain FROM part WHERE p_partkey % 100 = 0), n AS (SELECT p_partkey logical_id, {_PLAIN.format('p_name')} name, {_PLAIN.format(chr(39) + 'brand ' + chr(39) + ' || p_type')} title FROM part), x AS (SELECT qid, logical_id, (3.0 * len(list_intersect({_SPLIT.format('plain')}, {_SPLIT.format('name')})) + len(list_intersect({_SPLIT.format('plain')}, {_SPLIT.format('title')})) + CASE WHEN contains(plain, name) THEN 5.0 ELSE 0 END)::DOUBLE score FROM p, n) SELECT qid, logical_id, score FROM x WHERE score > 1")
def evolution_lexical_score(spark, sf_dir):
    """Parts as lineages, named by their names; every hundredth part's name is asked for."""
    part = table(spark, sf_dir, "part")
    asks = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("How has the "), "p_name", F.lit(" changed, Brand "), F.col("p_size").cast("string")).alias("text"))
    lineages = part.select(F.col("p_partkey").alias("logical_id"), F.col("p_name").alias("name"), F.array(F.lit("brand"), "p_type").alias("titles"))
    return lexical.lexical_evolution(asks, lineages, "name", above=1.0)


# ---------------------------------------------------------------- symbols and code


@register("WITH a AS (SELECT * FROM events WHERE event_type = 'view'), b AS (SELECT * FROM events WHERE event_type = 'purchase'), p AS (SELECT a.user_id, a.event_id first_id, b.event_id second_id, row_number() OVER (PARTITION BY a.user_id ORDER BY a.event_id, b.event_id) n FROM a JOIN b ON a.user_id = b.user_id AND a.ts < b.ts) SELECT user_id, first_id, second_id FROM p WHERE n = 1")
def ordered_pair_same_scope(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("scope", F.col("user_id"))
    p = symbolic.ordered_pairs(e, F.col("event_type") == "view", F.col("event_type") == "purchase", ["scope"], "ts", "event_id", "user_id")
    return p.select("user_id", F.col("a_event_id").alias("first_id"), F.col("b_event_id").alias("second_id"))


#: Lines of the source of each part p, by numbers that follow from p: a class with a method that calls two functions in either order, a nest of
#: p % 4 loops, and a recursive call if p % 3 is 0. Every 50th source is broken.
CODE = """'import lib' || p % 7 || '.io' || chr(10) || 'class C' || p % 5 || ':' || chr(10) || '    def f' || p % 11 || '(self, x):' || chr(10)
 || CASE WHEN p % 2 = 0 THEN '        print(x)' || chr(10) || '        range(x)' ELSE '        range(x)' || chr(10) || '        print(x)' END || chr(10)
 || CASE WHEN p % 4 >= 1 THEN '        for i0 in x:' || chr(10) ELSE '' END || CASE WHEN p % 4 >= 2 THEN '            for i1 in x:' || chr(10) ELSE '' END || CASE WHEN p % 4 >= 3 THEN '                for i2 in x:' || chr(10) ELSE '' END
 || CASE WHEN p % 4 >= 1 THEN repeat('    ', 2 + p % 4) || 'pass' || chr(10) ELSE '' END || CASE WHEN p % 3 = 0 THEN '        return self.f' || p % 11 || '(x)' ELSE '        return x' END"""
_SRC = f"s AS (SELECT p_partkey p, p_partkey % 50 <> 0 ok, p_partkey % 3 = 0 AND p_partkey % 50 <> 0 rec, p_partkey % 4 d, 'f' || p_partkey % 11 f, 'C' || p_partkey % 5 c, 'lib' || p_partkey % 7 || '.io' lib, CASE WHEN p_partkey % 2 = 0 THEN ['print', 'range'] ELSE ['range', 'print'] END two, 6 + p_partkey % 4 + (p_partkey % 4 > 0)::INT tail FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table of few bytes is read by one task, but its sources take long to parse
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")).repartition(spark.sparkContext.defaultParallelism, "p")
    return p.select(F.col("p").alias("id"), F.when(F.col("p") % 50 == 0, F.lit("def broken(:")).otherwise(F.expr(CODE)).alias("code"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("id", code_functions.metadata("code").alias("m")).select("id", "m.*")


_AT = "'@' || tail || ':' || f || ':' || c"


@register(f"""WITH {_SRC} SELECT p id, ok parsed, CASE WHEN ok THEN d ELSE 0 END::INT loop_count, CASE WHEN ok THEN d ELSE 0 END::INT max_loop_depth, CASE WHEN rec THEN [f] ELSE []::VARCHAR[] END recursive_functions,
 CASE WHEN ok THEN list_concat([two[1] || '@4:' || f || ':' || c, two[2] || '@5:' || f || ':' || c], CASE WHEN rec THEN ['self.' || f || {_AT}] ELSE []::VARCHAR[] END) ELSE []::VARCHAR[] END calls, CASE WHEN ok THEN [lib] ELSE []::VARCHAR[] END imports,
 CASE WHEN ok THEN [f || '@3:' || c] ELSE []::VARCHAR[] END functions, CASE WHEN ok THEN [c || '@2'] ELSE []::VARCHAR[] END classes, CASE WHEN ok THEN list_transform(range(0, d), lambda i: 'for@' || (6 + i) || ':' || (i + 1) || ':' || f || ':' || c) ELSE []::VARCHAR[] END loops,
 CASE WHEN ok THEN list_sort(list_concat(list_concat(['print', 'range', 'x'], list_transform(range(0, d), lambda i: 'i' || i)), CASE WHEN rec THEN ['self', 'self.' || f] ELSE []::VARCHAR[] END)) ELSE ['broken', 'def'] END identifiers,
 CASE WHEN ok AND d > 0 THEN c || '=' || d ELSE '' END class_depth, CASE WHEN ok AND d > 0 THEN f || '=' || d ELSE '' END function_depth FROM s""")
def ast_metadata(spark, sf_dir):
    """All twelve fields of the record."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    text = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    call = lambda c: text(c["name"], "@", c["line"].cast("string"), ":", dash(c["function"]), ":", dash(c["class"]))
    loop = lambda x: text(x["type"], "@", x["line"].cast("string"), ":", x["depth"].cast("string"), ":", dash(x["function"]), ":", dash(x["class"]))
    depth = lambda m: F.concat_ws(",", F.transform(F.map_entries(m), lambda e: text(e["key"], "=", e["value"].cast("string"))))
    return records(spark, sf_dir).select(
        "id", "parsed", "loop_count", "max_loop_depth", "recursive_functions", F.transform("calls", call).alias("calls"), F.transform("imports", lambda i: i["name"]).alias("imports"),
        F.transform("functions", lambda x: text(x["name"], "@", x["line"].cast("string"), ":", dash(x["class"]))).alias("functions"), F.transform("classes", lambda x: text(x["name"], "@", x["line"].cast("string"))).alias("classes"),
        F.transform("loops", loop).alias("loops"), "identifiers", depth("class_loop_depths").alias("class_depth"), depth("function_loop_depths").alias("function_depth"),
    )


@register(f"""WITH {_SRC} SELECT p id, CASE WHEN NOT ok THEN 'unparsed python code' ELSE 'classes: ' || lower(c) || ' | functions: ' || f || ' | parameters: self, x | imports: ' || lib || ' | calls: ' || two[1] || ', ' || two[2] || CASE WHEN rec THEN ', ' || f ELSE '' END || CASE WHEN rec THEN ' | attributes: ' || f ELSE '' END
 || ' | identifiers: ' || two[1] || ', x, ' || two[2] || CASE WHEN d > 0 THEN ', ' || array_to_string(list_transform(range(0, d), lambda i: 'i' || i), ', ') ELSE '' END || CASE WHEN rec THEN ', self' ELSE '' END
 || ' | structure: class x1, function x1' || CASE WHEN d > 0 THEN ', for loop x' || d ELSE '' END || CASE WHEN rec THEN ' | recursive functions: ' || f ELSE '' END END signature FROM s""")
def code_signatures(spark, sf_dir):
    return sources(spark, sf_dir).select("id", code_functions.code_signature("code").alias("signature"))


_LONG = "CASE p % 4 WHEN 0 THEN 'x = [' || array_to_string(range(0, 40 + p % 30), ',') || ']  # gone' WHEN 1 THEN 'y = \"' || repeat('a', 900 + p % 300) || '\"' WHEN 2 THEN 'def broken(:' || p ELSE 'z=(1,' || p || ')' END"


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source a part: lists of 40 to 69 numbers, strings of 900 to 1199 characters, broken ones and short ones."""
    p = F.col("p_partkey")
    numbers = F.concat(F.lit("x = ["), F.array_join(F.sequence(F.lit(0), (39 + p % 30).cast("int")), ","), F.lit("]  # gone"))
    text = F.concat(F.lit('y = "'), F.repeat(F.lit("a"), (900 + p % 300).cast("int")), F.lit('"'))
    code = F.when(p % 4 == 0, numbers).when(p % 4 == 1, text).when(p % 4 == 2, F.concat(F.lit("def broken(:"), p.cast("string"))).otherwise(F.concat(F.lit("z=(1,"), p.cast("string"), F.lit(")")))
    return table(spark, sf_dir, "part").select(p.alias("id"), code.alias("code"))


_COMPACT = f"""l AS (SELECT p_partkey p, p_partkey % 30 + 40 n, p_partkey % 300 + 900 m FROM part), k AS (SELECT p id, CASE p % 4 WHEN 0 THEN 'x = [' || array_to_string(range(0, CASE WHEN n > 50 THEN 8 ELSE n END), ', ') || CASE WHEN n > 50 THEN ', ''<LONG_LIST:' || n || '_ITEMS>''' ELSE '' END || ']'
 WHEN 1 THEN 'y = ''' || repeat('a', CASE WHEN m > 1000 THEN 120 ELSE m END) || CASE WHEN m > 1000 THEN '...<LONG_STRING:' || m || '_CHARS>' ELSE '' END || '''' WHEN 2 THEN 'def broken(:' || p ELSE 'z = (1, ' || p || ')' END code, {_LONG} original FROM l)"""


@register(f"WITH {_COMPACT} SELECT id, code FROM k")
def compacted_literals(spark, sf_dir):
    return literals(spark, sf_dir).select("id", code_functions.compact_literals("code").alias("code"))


@register(f"WITH {_COMPACT} SELECT count(*) documents, count(*) FILTER (code <> original) changed, max(len({TOKENS.replace('text', 'original')}))::BIGINT longest_before, max(len({TOKENS.replace('text', 'code')}))::BIGINT longest_after, count(*) FILTER (len({TOKENS.replace('text', 'original')}) > 50) over_before, count(*) FILTER (len({TOKENS.replace('text', 'code')}) > 50) over_after, sum(length(original))::BIGINT chars_before, sum(length(code))::BIGINT chars_after FROM k")
def compaction_effect(spark, sf_dir):
    return code_reports.compaction_effect(literals(spark, sf_dir), limits=(50,)).select("documents", "changed", "longest_before", "longest_after", F.col("over_50_before").alias("over_before"), F.col("over_50_after").alias("over_after"), "chars_before", "chars_after")


@register(f"WITH {_COMPACT}, c AS (SELECT id, len({TOKENS.replace('text', 'original')})::BIGINT before, len({TOKENS.replace('text', 'code')})::BIGINT AS after FROM k) SELECT id, before, after, before - after saved FROM c ORDER BY saved DESC, id LIMIT 10")
def compaction_savings(spark, sf_dir):
    return code_reports.compaction_savings(literals(spark, sf_dir), 10)


@register(f"WITH {_SRC} SELECT count(*) documents, count(*) FILTER (ok) parsed, count(*) FILTER (NOT ok) unparsed, count(*) FILTER (rec) recursive, count(*) FILTER (ok AND d >= 2) nested FROM s")
def index_counts(spark, sf_dir):
    return code_reports.index_counts(records(spark, sf_dir))


@register("SELECT p_partkey id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey - p_partkey % 4 ELSE p_partkey END same_as FROM part")
def code_fingerprints(spark, sf_dir):
    """Sources of even parts differ within a pair only in layout and comments; each names the first source with its fingerprint."""
    p = F.col("p_partkey")
    pair = (p - p % 4).cast("string")
    code = F.when(p % 4 == 0, F.concat(F.lit("x="), pair)).when(p % 2 == 0, F.concat(F.lit("x = "), pair, F.lit("  # note"))).when(p % 3 == 0, F.concat(F.lit("x = "), p.cast("string"), F.lit("."))).otherwise(F.concat(F.lit("x ="), p.cast("string"), F.lit(" = ")))
    prints = table(spark, sf_dir, "part").select(p.alias("id"), code_functions.code_fingerprint(code).alias("p"))
    first = prints.groupBy("p").agg(F.min("id").alias("same_as"))
    return prints.join(first, "p").select("id", "same_as")


@register("SELECT p_partkey id, substr(sha256('x ' || p_partkey), 1, 12) short, repeat('y', least(p_partkey, 500)::INT) preview FROM part")
def short_fingerprints(spark, sf_dir):
    """The first 12 digits of a fingerprint, and previews of at most 500 characters, of made texts of at most 1000, whatever the id."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    rows = p.select("id", text_fingerprint(F.concat(F.lit("x  "), F.col("id").cast("string"))).alias("f"), F.repeat(F.lit("y"), F.least("id", F.lit(1000)).cast("int")).alias("code"))
    return rows.select("id", short_fingerprint(F.col("f")).alias("short"), preview(F.col("code"), 500).alias("preview"))


def _usage(hits: DataFrame) -> DataFrame:
    return hits.select("id", r6("score").alias("score"), F.transform("evidence", lambda e: F.concat_ws("@", e["type"], e["name"], e["line"].cast("string"))).alias("evidence"))


_TOP20 = "ORDER BY score DESC, id::VARCHAR LIMIT 20"


@register(f"WITH {_SRC}, h AS (SELECT p id, (((lib = 'lib3.io')::INT + (rec OR (ok AND d >= 2))::INT) / 2)::DOUBLE score, list_concat(CASE WHEN lib = 'lib3.io' AND ok THEN ['import@lib3.io@1'] ELSE []::VARCHAR[] END, CASE WHEN ok AND d >= 2 THEN ['identifier@i1'] ELSE []::VARCHAR[] END) evidence FROM (SELECT * REPLACE (false AS rec) FROM s WHERE ok)) SELECT id, score, evidence FROM h WHERE score > 0 {_TOP20}")
def exact_usage_any(spark, sf_dir):
    return _usage(symbolic.exact_usage(records(spark, sf_dir), ["lib3", "i1"]))


@register(f"WITH {_SRC}, h AS (SELECT p id, 1.0::DOUBLE score, CASE WHEN two[1] = 'range' THEN ['call@range@4', 'call@print@5'] ELSE ['call@range@5', 'call@print@4'] END evidence FROM s WHERE ok) SELECT * FROM h {_TOP20}")
def exact_usage_all(spark, sf_dir):
    return _usage(symbolic.exact_usage(records(spark, sf_dir), ["range", "print"], categories=["calls"]))


@register(f"WITH {_SRC}, h AS (SELECT p id, 1.0::DOUBLE score, ['call@self.f4@' || tail] evidence FROM s WHERE rec AND f = 'f4') SELECT * FROM h {_TOP20}")
def exact_usage_in_functions(spark, sf_dir):
    return _usage(symbolic.exact_usage(records(spark, sf_dir), ["f4"], categories=["calls"], require_function=True))


@register(f"WITH {_SRC}, h AS (SELECT p id, 1.0::DOUBLE score, ['import@' || lib || '@1', 'import@' || lib || '@1'] evidence FROM s WHERE ok AND lib = 'lib5.io') SELECT * FROM h {_TOP20}")
def import_prefix_match(spark, sf_dir):
    return _usage(symbolic.exact_usage(records(spark, sf_dir), ["lib5", "io"], categories=["imports"]))


@register(f"WITH {_SRC} SELECT p id, 1.0::DOUBLE score, f AS function, c AS class, 4 first_line, 5 second_line FROM s WHERE ok AND two[1] = 'range' ORDER BY p LIMIT 20")
def call_order(spark, sf_dir):
    return symbolic.structural(records(spark, sf_dir), "which functions call range before print?", ["range", "print"])


@register(f"WITH {_SRC} SELECT p id, 1.0::DOUBLE score, f AS function, c AS class, 4 first_line, 5 second_line FROM s WHERE ok AND two[1] = 'range' ORDER BY 1000000 - p LIMIT 20")
def call_order_by_place(spark, sf_dir):
    """The first of the corpus in its own order, here from the greatest id down."""
    placed = records(spark, sf_dir).withColumn("pos", F.lit(1_000_000) - F.col("id"))
    return symbolic.structural(placed, "which functions call print after range?", ["print", "range"])


@register(f"WITH {_SRC}, h AS (SELECT p id, CASE WHEN f = 'f2' THEN 2.25 ELSE 2.0 END::DOUBLE score, list_concat(['recursive_function@' || f || '@3'], CASE WHEN f = 'f2' THEN ['function@f2@3', 'call@self.f2@' || tail] ELSE []::VARCHAR[] END) evidence FROM s WHERE rec) SELECT * FROM h {_TOP20}")
def recursion_docs(spark, sf_dir):
    return _usage(symbolic.structural(records(spark, sf_dir), "find recursive functions f2", ["f2"]))


@register(f"WITH {_SRC}, h AS (SELECT p id, (2 + d)::DOUBLE score, ['recursive_function@' || f || '@3', 'loop_structure@nested loops'] evidence FROM s WHERE rec AND d >= 2) SELECT * FROM h {_TOP20}")
def recursion_and_nested_loops(spark, sf_dir):
    return _usage(symbolic.structural(records(spark, sf_dir), "recursive code with nested loops", []))


@register(f"WITH {_SRC}, n AS (SELECT unnest([{{'scope': 'class', 'name': c}}, {{'scope': 'function', 'name': f}}, {{'scope': 'any', 'name': 'nested loops'}}]) u, p id, d::DOUBLE score FROM s WHERE ok AND d >= 2), r AS (SELECT u.scope, id, score, u.name, row_number() OVER (PARTITION BY u.scope ORDER BY score DESC, id::VARCHAR) k FROM n) SELECT scope, id, score, name FROM r WHERE k <= 20")
def nested_loops_by_scope(spark, sf_dir):
    asks = {"class": "which classes have nested loops", "function": "functions having nested loops", "any": "nested loops"}
    out = [symbolic.structural(records(spark, sf_dir), q, []).select(F.lit(k).alias("scope"), "id", "score", F.col("evidence")[0]["name"].alias("name")) for k, q in asks.items()]
    return reduce(DataFrame.unionByName, out)


@register(f"WITH {_SRC} SELECT 'functions' category, count(*) n FROM s WHERE ok AND f = 'f3' UNION ALL SELECT 'calls', count(*) FROM s WHERE rec AND f = 'f3'")
def symbol_categories(spark, sf_dir):
    """How often a name is defined and called, from the symbol table."""
    found = symbolic.symbols(records(spark, sf_dir)).where(symbolic.symbol_matches(F.col("name"), F.col("category"), "f3") & F.col("category").isin("functions", "calls"))
    return found.groupBy("category").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- checks, joins and reports


@register("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def split_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def label_flag_join(spark, sf_dir):
    flag = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(flag, "doc_id", "left").select("doc_id", F.col("there").isNotNull().alias("labelled"))


@register("WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT (SELECT count(*) FROM a) n_a, (SELECT count(*) FROM b) n_b, (SELECT count(*) FROM a JOIN b USING (doc_id)) shared, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) only_a, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) only_b")
def selection_overlap(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return validation.selection_overlap(labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


@register("WITH x AS (SELECT d.doc_id, p.url ua, q.url ub FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN pages q ON q.page_id = d.doc_id - d.doc_id % 2) SELECT CASE WHEN trim(coalesce(ua, '')) = '' OR trim(coalesce(ub, '')) = '' THEN 'missing' WHEN trim(ua) = trim(ub) THEN 'matched' ELSE 'mismatched' END alignment, count(*) n FROM x GROUP BY 1")
def label_alignment(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") - F.col("doc_id") % 2).alias("b"))
    return validation.label_alignment(pairs, pages.select(F.col("page_id").alias("a"), "url"), pages.select(F.col("page_id").alias("b"), "url"))


@register(f"WITH {R}, run AS (SELECT qid, CASE WHEN qid % 200 = 0 AND rank = 2 THEN -1 ELSE doc_id END doc_id FROM r WHERE rank <= CASE WHEN qid = 100 THEN 7 ELSE 10 END), o AS (SELECT qid, count(*) n, count(DISTINCT doc_id) d FROM run GROUP BY 1) SELECT qid, 'wrong length' problem FROM o WHERE n <> 10 UNION ALL SELECT qid, 'repeated document' FROM o WHERE n > d UNION ALL SELECT DISTINCT qid, 'unknown document' FROM run WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT -5, 'missing query'")
def validate_rankings(spark, sf_dir):
    r = best(spark, sf_dir, 10).where(F.col("rank") <= F.when(F.col("qid") == 100, 7).otherwise(10))
    run = r.select("qid", F.when((F.col("qid") % 200 == 0) & (F.col("rank") == 2), F.lit(-1)).otherwise(F.col("doc_id")).alias("doc_id"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    asked_for = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid")).unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("qid")))
    return validation.ranking_problems(run, asked_for, e, 10)


@register("WITH a AS (SELECT DISTINCT doc_id FROM labels), d AS (SELECT DISTINCT doc_id FROM documents) SELECT (SELECT count(*) FROM (FROM a ANTI JOIN d USING (doc_id))) + (SELECT count(*) FROM (FROM d ANTI JOIN a USING (doc_id))) = 0 same, (SELECT count(*) FROM (FROM d ANTI JOIN a USING (doc_id))) only_a, (SELECT count(*) FROM (FROM a ANTI JOIN d USING (doc_id))) only_b, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1 UNION SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) repeated")
def id_set_equality(spark, sf_dir):
    return validation.same_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@register("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def key_list_filter(spark, sf_dir):
    return validation.only_keys(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@register("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS partition, source FROM documents WHERE doc_id % 5 <> 0")
def partition_filter(spark, sf_dir):
    """The documents of one partition."""
    d = table(spark, sf_dir, "documents").withColumn("partition", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return validation.in_partition(d, "train").select("doc_id", "partition", "source")


@register("SELECT text, count(*) n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return validation.duplicates(table(spark, sf_dir, "documents"), "text")


@register("SELECT round(quantile_cont(n_chars, 0.5)::DOUBLE, 6) p50, round(quantile_cont(n_chars, 0.9)::DOUBLE, 6) p90, round(quantile_cont(n_chars, 0.95)::DOUBLE, 6) p95, round(quantile_cont(n_chars, 0.99)::DOUBLE, 6) p99 FROM documents")
def length_percentiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(*(r6(F.percentile("n_chars", F.lit(p / 100))).alias(f"p{p}") for p in (50, 90, 95, 99)))


@register("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@register("SELECT lang, count(*) n, count(*) FILTER (n_chars > 2048) over_2048, count(*) FILTER (n_chars > 4096) over_4096, max(n_chars) longest FROM documents GROUP BY lang")
def length_summary(spark, sf_dir):
    over = lambda n: F.count_if(F.col("n_chars") > n)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), over(2048).alias("over_2048"), over(4096).alias("over_4096"), F.max("n_chars").alias("longest"))


@register("SELECT item_id AS id, '' title, 'PYTHON' language, text AS code FROM benchmark")
def project_corpus(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("").alias("title"), F.lit("PYTHON").alias("language"), F.col("text").alias("code"))


@register("SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) fingerprint FROM documents")
def text_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_fingerprint(F.col("text")).alias("fingerprint"))


@register(f"WITH t AS (SELECT doc_id, source, list_distinct({TOKENS}) toks FROM documents), p AS (SELECT a.doc_id a, b.doc_id b, a.toks x, b.toks y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1) SELECT a, b, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) similarity FROM p")
def token_jaccard_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", token_set(F.col("text")).alias("x"))
    other = t.select(F.col("doc_id").alias("b"), F.col("x").alias("y"))
    return t.select(F.col("doc_id").alias("a"), "x").join(other, F.col("b") == F.col("a") + 1).select("a", "b", r6(jaccard(F.col("x"), F.col("y"))).alias("similarity"))
