"""One query from text to answer: validation, routing, one lazy plan a route, envelope."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import dense, fusion, router, symbolic, versions

MOST_CHARS, MOST_RESULTS = 20_000, 50


class InvalidRequest(ValueError):
    """Maps to 422."""


class Unavailable(OSError):
    """Maps to 503."""


def status(error: Exception) -> int:
    return 422 if isinstance(error, ValueError) else 503 if isinstance(error, OSError) else 500


SCOPES = ("auto", "all", "latest", "commit")


@dataclass
class Request:
    """A query with its version scope; `commit:<id>` is short for the scope commit and that commit."""

    query: str
    top_k: int = 10
    scope: str | None = "auto"
    commit: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.query, str) or not 1 <= len(self.query) <= MOST_CHARS or not self.query.strip():
            raise InvalidRequest(f"a query has 1 to {MOST_CHARS} characters")
        if not isinstance(self.top_k, int) or not 1 <= self.top_k <= MOST_RESULTS:
            raise InvalidRequest(f"top_k is 1 to {MOST_RESULTS}")
        self.scope = self.scope or "auto"
        if self.scope.startswith("commit:"):
            self.scope, self.commit = "commit", self.scope.partition(":")[2]
        if self.scope not in SCOPES:
            raise InvalidRequest(f"a scope is one of {', '.join(SCOPES)}")
        if self.scope == "commit" and not self.commit:
            raise InvalidRequest("the scope commit names a commit")
        self.query = self.query.strip()


class Index:
    """The tables that sources.io.build_index and plans.history write in a folder; each is opened once, when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame | None] = {}
        self._lock = threading.RLock()

    def table(self, name: str) -> DataFrame | None:
        with self._lock:
            if name not in self._tables:
                try:
                    self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}")
                except Exception as e:
                    if "PATH_NOT_FOUND" not in str(e):
                        raise Unavailable(f"the table {name} can't be read") from e
                    self._tables[name] = None
            return self._tables[name]


_OPEN: dict[tuple[str, str], Engine] = {}
_OPENING = threading.Lock()


def open_engine(spark: SparkSession, folder: str, **options: Any) -> Engine:
    """One engine a folder and session, whoever asks; options as Engine's own."""
    key = (spark.sparkContext.applicationId, folder)
    with _OPENING:
        if key not in _OPEN:
            index = Index(spark, folder)
            corpus = index.table("corpus")
            if corpus is None:
                raise Unavailable("there is no index")
            _OPEN[key] = Engine(spark, corpus, index.table("records"), index.table("vectors"), versioned=index.table("versions"), snapshots=index.table("snapshots"), symbols=index.table("symbols"), **options)
        return _OPEN[key]


@dataclass
class Engine:
    """Tables of an index, any of which may be absent; encode gives one query's vectors by model, scorer a column of (query, code) scores."""

    spark: SparkSession
    corpus: DataFrame
    records: DataFrame | None = None
    vectors: DataFrame | None = None  # id, vec: the models' vectors end to end
    parts: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    versioned: DataFrame | None = None  # version records with append_seq and vec
    snapshots: DataFrame | None = None
    encode: Any = None
    symbols: DataFrame | None = None  # symbolic.symbols() of the records
    scorer: Any = None
    threshold: float = 0.5  # a margin above it needs no second look
    rerank_depth: int = 20
    blend: float = 0.2

    def semantic(self, query: str, k: int) -> tuple[DataFrame, dict]:
        """Hits by fused scores; if the best two lie close, the first ones are scored in pairs and blended."""
        if self.vectors is None or self.encode is None:
            raise Unavailable("there are no vectors")
        clock = _Clock()
        q = self.spark.createDataFrame([(0, [float(x) for x in self.encode(query)])], "qid int, vec array<double>")
        clock("encode")
        depth = max(k, self.rerank_depth, 2)
        best = dense.fused_head(q, self.vectors, self.parts, self.weights, depth, doc_id="id")
        kind = best.select("qid", "doc_id", "score", "rank").schema
        rows = best.select("qid", "doc_id", "score", "rank").orderBy("rank").collect()  # `depth` rows
        clock("dense")
        margin = rows[0].score - rows[1].score if len(rows) > 1 else None
        gated = self.scorer is not None and margin is not None and margin <= self.threshold
        ranked = self.spark.createDataFrame(rows, kind)
        if gated:
            text = "retrieval_code" if "retrieval_code" in self.corpus.columns else "code"
            codes = self.corpus.select(F.col("id").alias("doc_id"), F.col(text).alias("_code"))
            head = ranked.where(F.col("rank") <= self.rerank_depth).join(codes, "doc_id").select("doc_id", self.scorer(F.lit(query), F.col("_code")).alias("second"))
            ranked = fusion.rerank(ranked.join(head, "doc_id", "left"), "second", self.spark.createDataFrame([(0, True)], "qid int, gated boolean"), self.rerank_depth, self.blend)
            ranked = self.spark.createDataFrame(ranked.select("qid", "doc_id", "score", F.col("new_rank").cast("int").alias("rank")).collect(), kind)
            clock("rerank")
        hits = ranked.where(F.col("rank") <= k).select(F.col("doc_id").alias("id"), "score", "rank")
        return self._documents(hits).orderBy("rank"), {"confidence_margin": margin, "confidence_threshold": self.threshold, "reranker_triggered": gated, "timings_ms": clock.taken}

    def exact(self, query: str, terms: list[str], k: int) -> DataFrame:
        table = self.symbols if self.symbols is not None else self.records
        if table is None:
            raise Unavailable("there is no symbol index")
        categories, in_function = symbolic.category_of(query)
        return self._with_code(symbolic.exact_usage(table, terms, k, categories, in_function))

    def structural(self, query: str, terms: list[str], k: int) -> DataFrame:
        if self.records is None:
            raise Unavailable("there is no symbol index")
        return self._with_code(symbolic.structural(self.records, query, terms, k))

    def _documents(self, hits: DataFrame) -> DataFrame:
        """Hits with their documents, which join after the limit; a hit without one is an error."""
        there = hits.join(self.corpus.withColumn("_there", F.lit(True)), "id", "left")
        missing = F.raise_error(F.concat(F.lit("no document "), F.col("id").cast("string"))).cast(hits.schema["id"].dataType)
        return there.withColumn("id", F.when(F.col("_there").isNull(), missing).otherwise(F.col("id"))).drop("_there")

    def _with_code(self, hits: DataFrame) -> DataFrame:
        return self._documents(hits).orderBy(F.desc("score"), F.col("id").cast("string"))

    def evolution(self, query: str, k: int, scope: str, commit: str | None = None) -> DataFrame | None:
        if self.versioned is None:
            return None
        chosen = versions.in_scope(self.versioned, scope, "append_seq", self.snapshots, commit)
        if self.encode is None:
            raise Unavailable("there is no encoder")
        first = self.versioned.select("vec").where("vec IS NOT NULL").first()
        if first is None:
            raise Unavailable("there are no vectors of versions")
        width = len(first.vec)
        q = self.spark.createDataFrame([(0, [float(x) for x in self.encode(query)][:width])], "qid int, vec array<double>")
        keyed = chosen.withColumn("doc_id", F.struct("logical_id", "append_seq").cast("string"))
        best = dense.fused_head(q, keyed, {"own": (0, width)}, {"own": 1.0}, k).select("doc_id", "score", "rank")
        hits = best.join(keyed.drop("vec"), "doc_id").select("logical_id", "version", "code", "append_seq", "score", "rank")
        lines = versions.timeline_until(hits, self.versioned, "append_seq", scope == "commit")
        timeline = lines.groupBy("logical_id", F.col("hit_at").alias("append_seq")).agg(F.array_sort(F.collect_list(F.struct("at", "version", "change_type"))).alias("timeline"))
        return hits.join(timeline, ["logical_id", "append_seq"]).orderBy("rank")

    def search(self, request: Request) -> dict:
        """plan, execution, results and total_ms; the results are at most top_k rows."""
        clock = _Clock()
        plan = router.plan_query(request.query, None if request.scope == "auto" else request.scope)
        clock("plan")
        terms = list(plan.terms)
        out: dict = {"query": request.query, "plan": asdict(plan)}
        if plan.route == "evolution":
            found = self.evolution(request.query, request.top_k, "all" if request.scope == "auto" else request.scope, request.commit)
        elif plan.route == "structural":
            found = self.structural(request.query, terms, request.top_k)
        elif plan.route == "exact_usage":
            found = self.exact(request.query, terms, request.top_k)
        else:
            found, out["retrieval"] = self.semantic(request.query, request.top_k)
        rows = [] if found is None else [json.loads(x) for x in found.toJSON().collect()]
        clock(plan.route)
        steps = [{"step": k, "ms": v} for k, v in clock.taken.items()]
        return {**out, "execution": {"available": found is not None, "steps": steps}, "results": rows, "total_ms": clock.total()}


class _Clock:
    """Milliseconds of steps."""

    def __init__(self) -> None:
        self.began = self.last = time.perf_counter()
        self.taken: dict[str, float] = {}

    def __call__(self, step: str) -> None:
        now = time.perf_counter()
        self.taken[step], self.last = 1000 * (now - self.last), now

    def total(self) -> float:
        return 1000 * (time.perf_counter() - self.began)


def main(words: list[str], engine: Engine) -> str:
    """The command line's answer: all words are one query, five results."""
    return json.dumps(engine.search(Request(" ".join(words), 5)), indent=1, ensure_ascii=False)
