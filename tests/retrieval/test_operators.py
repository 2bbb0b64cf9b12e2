"""Operators on small fixtures: edge cases, errors, sources and sinks, search, streams."""

import json
import math
import re
import subprocess

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import code as code_functions
from lexmill.functions.scores import numbered, standardize
from lexmill.operators import dense, encode, fusion, learned, lexical, metrics, router, symbolic, validation, versions
from lexmill.plans.search import Engine, InvalidRequest, Request, Unavailable, main, status
from lexmill.sources import io
from lexmill.sources.git import GitSource, check_path
from lexmill.streaming.lineage import append_stream


SOURCES = [
    ("s1", "import os.path\ndef f(n):\n    return f(n - 1)"),
    ("s2", "class A:\n    def g(self):\n        for i in range(3):\n            for j in range(3):\n                print(i)"),
    ("s3", "print(range(3))"),
    ("s4", "def broken(:"),
]
ASKED = [
    (1, "check whether a tic tac toe board state is valid"), (2, "find code that performs binary search"), (3, "which functions call parse_config before save_config?"),
    (4, "find usages of torch.nn.Linear"), (5, "which files import requests?"), (6, "find recursive functions that traverse a tree"),
    (7, "show how this implementation changed between versions"), (8, "find the older implementation of authentication"), (9, "which classes contain nested loops?"),
    (10, "code that sorts a string according to a custom ordering"), (11, "which files import math?"), (12, "which functions call range before print?"), (13, "show binary search version history"), (14, "use a heap"),
]


def sources(spark):
    return spark.createDataFrame(SOURCES, "id string, code string")


def records(spark):
    return sources(spark).select("id", code_functions.metadata("code").alias("m")).select("id", "m.*")


def test_routes(spark):
    want = ["semantic", "semantic", "structural", "exact_usage", "exact_usage", "structural", "evolution", "evolution", "structural", "semantic", "exact_usage", "structural", "evolution", "exact_usage"]
    got = spark.createDataFrame([*ASKED, (99, None)], "qid int, text string").select("qid", router.plan_column(F.col("text")).alias("p")).orderBy("qid").collect()
    assert [r.p.route for r in got] == [*want, "semantic"]
    terms = {r.qid: list(r.p.terms) for r in got}
    assert terms[3] == ["parse_config", "save_config"] and terms[4] == ["torch.nn.Linear"] and terms[7] == [] and terms[9] == ["nested", "loops"]
    assert router.plan_query("anything", "latest").confidence == 1.0
    for (_, text), r in zip(ASKED, got, strict=False):
        plan = router.plan_query(f" {text} ")
        assert (plan.route, plan.confidence, plan.reason, list(plan.terms)) == (r.p.route, r.p.confidence, r.p.reason, list(r.p.terms))


def test_fusion_is_invariant(spark):
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip([0, 1, 2], [20, 10, 0], strict=True))]
    order = lambda r: [x.doc_id for x in fusion.fuse(spark.createDataFrame(r, "qid int, doc_id int, a double, b double"), {"a": 0.65, "b": 0.35}).orderBy(F.desc("score"), "doc_id").collect()]
    assert order(rows) == [2, 1, 0] == order([(q, d, 2 * a, b + 10) for q, d, a, b in rows])
    flat = standardize(spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "qid int, doc_id int, a double"), ["a"])
    assert [r.z_a for r in flat.collect()] == [0.0, 0.0]


def test_dense_blocks_and_nulls(spark):
    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(5)] + [(9, None)], "qid int, vec array<double>")
    d = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(7)] + [(99, None)], "doc_id int, vec array<double>")
    one = {(r.qid, r.doc_id): r.score for r in dense.scores(q, d, {"score": (0, 4)}).collect()}
    two = {(r.qid, r.doc_id): r.score for r in dense.scores(q, d, {"score": (0, 4)}, block=2).collect()}
    assert len(one) == 35 and one == pytest.approx(two)
    assert dense.scores(q.limit(0), d, {"score": (0, 4)}).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in lexical.bm25(spark.createDataFrame([(0, "b b"), (1, None), (2, "unseen")], "qid int, text string"), docs).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3))), abs=1e-6)}
    many = spark.createDataFrame([(i, "a b") for i in range(1500)], "qid int, text string")
    assert lexical.bm25(many, docs, depth=1).count() == 1500  # two blocks of queries, equal scores by id
    assert lexical.bm25(many.limit(0), docs).count() == 0 and lexical.bm25(many, docs.limit(0)).count() == 0


def test_tokens_are_counted_in_slices():
    rows = [["a"] * 3, [], None, ["b"] * 9, ["c"] * 2, ["d"] * 2, []]
    got = [x.to_pylist() for x in lexical._slices(pa.array(rows, pa.list_(pa.string())), 5)]
    assert [r for x in got for r in x] == rows and got == [rows[:3], rows[3:4], rows[4:]]
    assert all(len(x.flatten()) <= 300_000 for x in lexical._slices(pa.array([["a", "b"] * 500] * 2000)))
    assert list(lexical._slices(pa.array([], pa.list_(pa.string())))) == []


def test_heads_against_whole_rankings(spark):
    rng = np.random.default_rng(5)
    vec = lambda: [float(x) for x in rng.integers(-2, 3, 6)]
    docs = spark.createDataFrame([*((i, vec()) for i in range(300)), (999, None)], "doc_id int, vec array<double>").repartition(7)
    asks = spark.createDataFrame([(i, vec()) for i in range(40)], "qid int, vec array<double>")
    parts, weights = {"a": (0, 4), "b": (4, 6)}, {"a": 0.6, "b": 0.4}
    whole = fusion.fuse(dense.scores(asks, docs, parts), weights).withColumn("score", F.round("score", 6))
    for depth in (1, 3, 20, 500):
        want = {(r.qid, r.rank): (r.doc_id, r.score) for r in dense.top_k(whole, depth).collect()}
        got = {(r.qid, r.rank): (r.doc_id, r.score) for r in dense.fused_head(asks, docs, parts, weights, depth, block=16).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
    assert dense.fused_head(asks.limit(0), docs, parts, weights, 3).count() == 0
    named = docs.selectExpr("concat('d', lpad(doc_id, 4, '0')) AS doc_id", "vec")
    got = {(r.qid, r.rank): r.doc_id for r in dense.fused_head(asks, named, parts, weights, 3).collect()}
    assert got == {(r.qid, r.rank): f"d{r.doc_id:04d}" for r in dense.fused_head(asks, docs, parts, weights, 3).collect()}


@pytest.mark.parametrize("named", [False, True])
def test_counted_places_against_whole_rankings(spark, named):
    rng = np.random.default_rng(12)
    vec = lambda: [float(x) for x in rng.integers(-2, 3, 6)]
    doc = (lambda i: f"d{i:04d}") if named else (lambda i: i)
    kind = "doc_id string, vec array<double>" if named else "doc_id int, vec array<double>"
    docs = spark.createDataFrame([*((doc(i), vec()) for i in range(300)), (doc(999), None)], kind).repartition(2)
    asks = spark.createDataFrame([*((i, vec()) for i in range(40)), (77, None)], "qid int, vec array<double>")
    parts, weights = {"a": (0, 4), "b": (4, 6), "c": (0, 2)}, {"a": 0.6, "b": 0.4}
    whole = dense.scores(asks, docs, parts).cache()
    one = spark.createDataFrame([*((i, doc(int(rng.integers(0, 300)))) for i in range(35)), (36, doc(999)), (37, doc(5000)), (77, doc(1))], docs.schema.fields[0].dataType.simpleString() == "string" and "qid int, doc_id string" or "qid int, doc_id int")
    rounded = lambda d: d.withColumn("score", F.round("score", 6))
    want = {(r.qid, r.doc_id): r["rank"] for r in metrics.strict_rank(rounded(fusion.fuse(whole, weights)), one).collect()}
    got = dense.places(asks, docs, parts, dense.fused(weights), ["score"], one, block=32)
    assert len(want) == 35 and {(r.qid, r.doc_id): r.above_score + 1 for r in got.collect()} == want

    grid = rounded(fusion.weight_grid(standardize(whole, ["a", "b"]), "z_a", "z_b", [0.0, 0.3]))
    placed = fusion.ranks(grid.withColumn("wq", F.struct("weight", "qid")), ["score"], by="wq")
    several = one.unionByName(one.select("qid", F.lit(doc(3)).alias("doc_id"))).distinct()  # one goal a query, and two
    for goals in (one, several):
        want = {(r.weight, r.qid, r.doc_id): r.rank_score for r in placed.join(goals, ["qid", "doc_id"]).collect()}
        got = dense.places(asks, docs, parts, dense.grid("a", "b", [0.0, 0.3]), ["w0", "w1"], goals, block=32).collect()
        assert {(w, r.qid, r.doc_id): r[f"above_{c}"] + r[f"before_{c}"] + 1 for r in got for w, c in ((0.0, "w0"), (0.3, "w1"))} == want

    ranks = fusion.ranks(whole, ["a", "b", "c"]).cache()
    for depth in (5, 400):
        want = {(r.qid, r.doc_id): (r.rank_a, r.rank_b, r.rank_c) for r in ranks.where(F.least("rank_a", "rank_b", "rank_c") <= depth).collect()}
        assert {(r.qid, r.doc_id): (r.rank_a, r.rank_b, r.rank_c) for r in dense.head_ranks(asks, docs, parts, depth, block=32).collect()} == want
    for w in ({"a": 0.65, "b": 0.35}, {"b": 1.0, "c": 0.0}):
        best = lambda r: dense.top_k(fusion.reciprocal_rank_fusion(r, w).withColumn("score", F.round("score", 9)), 6).select("qid", "doc_id", "rank")  # noqa: B023, E731
        depth = fusion.reach(list(w.values()), 6)
        assert sorted(best(ranks).collect()) == sorted(best(dense.head_ranks(asks, docs, parts, depth, block=32)).collect()) and depth < 200

    want = {(r.qid, r.rank): r.doc_id for r in dense.top_k(rounded(fusion.structural_fusion(whole, weights, "c", 0.2)), 8).collect()}
    assert {(r.qid, r.rank): r.doc_id for r in dense.head(asks, docs, parts, dense.structural(weights, "c", 0.2), 8, block=32).collect()} == want
    for q, d in ((asks.limit(0), docs), (asks, docs.limit(0)), (asks, docs.where("vec IS NULL"))):
        assert dense.places(q, d, parts, dense.fused(weights), ["score"], one).count() == 0 == dense.head_ranks(q, d, parts, 3).count()
        assert dense.head(q, d, parts, dense.structural(weights, "c", 0.2), 3).count() == 0


def test_score_matrices_are_bounded(spark):
    docs = spark.createDataFrame([(0, [0.0, 1.0])], "doc_id int, vec array<double>")
    b = dense.Block(docs, {"a": (0, 2)}, list(range(1024)), np.ones((1024, 2)), "doc_id", "vec", None)
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(5000), "vec": pa.array(np.ones((5000, 2)).tolist())})
    found = list(b.products()(iter([batch])))
    assert sum(rows.num_rows for rows, _ in found) == 5000 and max(raw["a"].size for _, raw in found) <= 500_000


def test_reach_wants_weights():
    with pytest.raises(ValueError):
        fusion.reach([-0.1, 1.0], 10)
    with pytest.raises(ValueError):
        fusion.reach([0.0, 0.0], 10)


def test_deviations_of_scores_that_differ_little(spark):
    docs = spark.createDataFrame([(i, [30000.0 + i % 3 * 1e-4, 1.0]) for i in range(90)], "doc_id int, vec array<double>")
    got = dense.scores(spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vec array<double>"), docs, {"a": (0, 2)}, recipe=dense.standard(["a"]), names=["z_a"]).collect()
    assert {r.doc_id % 3: r.z_a for r in got} == pytest.approx({0: -math.sqrt(1.5), 1: 0.0, 2: math.sqrt(1.5)}, abs=1e-3)


def test_best_of_a_task():
    rng = np.random.default_rng(9)
    best, rows = dense.Best(5, 3), []
    best.most = 40
    for _ in range(30):
        q, d, x = rng.integers(0, 3, 12), rng.integers(0, 10**6, 12), rng.integers(0, 6, 12).astype(float)
        best.add(q, pa.array(d), x, other=x * 2)
        rows += zip(q.tolist(), d.tolist(), x.tolist(), strict=True)
    got = best.kept()
    want = [r for k in range(3) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:5]]
    assert list(zip(got["query"].tolist(), got["doc"].tolist(), got["score"].tolist(), strict=True)) == want and (got["other"] == 2 * got["score"]).all()


def test_names_are_scored_where_they_lie(spark):
    rng = np.random.default_rng(11)
    words = ["red", "re", "Bolt", "gear-box", "ring", "x1"]
    some = lambda most: " ".join(rng.choice(words, rng.integers(0, most)).tolist())
    asks = [*((i, "how has " + some(5)) for i in range(40)), (40, None), (41, "")]
    entries = [*((i, some(3), [some(3), None]) for i in range(60)), (60, None, None), (61, "nuts", ["a nut"]), (62, "has re", [])]
    plain = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", (t or "").lower()).split())
    want = {}
    for q, text in asks:
        for k, name, titles in entries:
            own, t = set(plain(text).split()), plain(" ".join(x for x in titles or [] if x))
            score = 3.0 * len(own & set(plain(name).split())) + len(own & set(t.split())) + 5.0 * (plain(name) != "" and plain(name) in plain(text))
            want[q, k] = score
    found = lambda above, block: lexical.lexical_evolution(spark.createDataFrame(asks, "qid int, text string"), spark.createDataFrame(entries, "logical_id int, name string, titles array<string>"), "name", above, block)
    for above in (0.0, 1.0, 4.0):
        assert {(r.qid, r.logical_id): r.score for r in found(above, 7).collect()} == {k: v for k, v in want.items() if v > above}
    plan = found(0.0, 1024)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_ordered_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 12)), i, rng.choice(["x", "y", "z"]).item(), int(rng.integers(0, 9)), [None, "f", "g"][rng.integers(0, 3)]) for i in range(400)]
    got = symbolic.ordered_pairs(spark.createDataFrame(rows, "id int, n int, name string, line int, f string"), F.col("name") == "x", F.col("name") == "y", ["f"], "line", "n")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] == "x" and b[2] == "y" and a[4] == b[4] and a[3] < b[3]:
                want[a[0]] = min(want.get(a[0], (1e9, 1e9)), (a[1], b[1]))
    assert {r.id: (r.a_n, r.b_n) for r in got.collect()} == want


def test_numbers_in_order(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.integers(0, 40))) for i in range(1000)]
    df = spark.createDataFrame(rows, "qid int, margin double")
    got = {r.qid: r.place for r in numbered(df, "margin", "qid").collect()}
    assert got == {q: i + 1 for i, (q, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for share in (0.0, 0.3, 0.517, 1.0):
        assert fusion.threshold(df, share).first().threshold == pytest.approx(np.quantile([m for _, m in rows], share))
        assert fusion.lowest_share(df, share).count() == int(1000 * share)
    assert fusion.threshold(df.limit(0)).first().threshold is None


def test_bootstrap_is_a_poisson_resample(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0.1, 1.0, 800)
    r = metrics.bootstrap(spark.createDataFrame([(f"q{i}", float(v)) for i, v in enumerate(values)], "qid string, delta double")).first()
    spread = 1.96 * values.std() / np.sqrt(800)
    assert r.mean == pytest.approx(values.mean(), abs=0.01) and r.low == pytest.approx(values.mean() - spread, abs=0.03) and r.high == pytest.approx(values.mean() + spread, abs=0.03)
    ranks = lambda *x: spark.createDataFrame([(v,) for v in x], "rank int")
    assert metrics.accepted(spark.createDataFrame([(0.1,)], "low double"), ranks(2, 200), ranks(1, 300)).first().accepted
    assert not metrics.accepted(spark.createDataFrame([(0.1,)], "low double"), ranks(1), ranks(2)).first().accepted
    assert not metrics.accepted(spark.createDataFrame([(-0.1,)], "low double"), ranks(2), ranks(1)).first().accepted


def test_checks_of_sets_and_partitions(spark):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    assert tuple(validation.same_ids(ids("a", "b"), ids("b", "a")).first()) == (True, 0, 0, 0)
    assert tuple(validation.same_ids(ids("a", "b", "b"), ids("a", "c")).first()) == (False, 1, 1, 1)
    assert sorted(r.id for r in validation.only_keys(ids("a", "b", "b"), ids("b", "b", "z"), "id").collect()) == ["b", "b"]
    with pytest.raises(ValueError):
        validation.in_partition(ids("a"), "valid", "id")
    rows = spark.createDataFrame([(i,) for i in range(2000)], "k int")
    assert validation.hash_sample(rows, 50, 1, "k").collect() == validation.hash_sample(rows.repartition(3), 50, 1, "k").collect()
    shares = {r[0]: r[1] for r in rows.groupBy(validation.hash_split(F.col("k"), 0.8, 3).alias("part")).count().collect()}
    assert shares.keys() == {"train", "validation"} and 1500 < shares["train"] < 1700
    assert validation.parity({"a": 1.0, "b": 2.0}, {"a": 1.0, "b": 2.1, "c": 0.0}) == ["b: 2.0 is not 2.1", "c: None is not 0.0"]
    scorer = encode.pair_scorer(lambda: lambda pairs: [float(len(a) - len(b)) for a, b in pairs])
    assert [r.s for r in spark.createDataFrame([("abc", "a"), (None, "ab")], "a string, b string").select(scorer("a", "b").alias("s")).collect()] == [2.0, -2.0]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "b", 1), ("none", "z", 0)], "qid string, doc_id string, rel int")
    got = {r.qid: r for r in metrics.graded(run, rel).collect()}
    assert got["q"].mrr == 0.5 and got["q"].ndcg == pytest.approx(1 / 1.584962500721156) and got["q"].ap == 0.5
    assert got["none"].ndcg == got["none"].recall == 0.0


def test_ranking_problems(spark):
    q, d = spark.createDataFrame([("x",), ("y",)], "qid string"), spark.createDataFrame([("a",), ("b",)], "doc_id string")
    run = spark.createDataFrame([("x", "a"), ("x", "a"), ("z", "c")], "qid string, doc_id string")
    assert {(r.qid, r.problem) for r in validation.ranking_problems(run, q, d, 2).collect()} == {("y", "missing query"), ("z", "extra query"), ("z", "wrong length"), ("x", "repeated document"), ("z", "unknown document")}


def test_symbols(spark):
    fields = "functions array<struct<name:string,line:int,class:string>>, classes array<struct<name:string,line:int>>, imports array<struct<name:string,line:int>>, calls array<struct<name:string,line:int,function:string,class:string>>"
    rows = [("a", [], [], [], [("collections", 1, None, None)], ["collections"]), ("b", [], [], [("collections.defaultdict", 2)], [], [])]
    table = spark.createDataFrame(rows, f"id string, {fields}, identifiers array<string>")
    assert symbolic.category_of("which files import collections?") == (["imports"], False)
    assert symbolic.category_of("which functions call f?") == (["calls"], True)
    hits = symbolic.exact_usage(table, ["collections"], categories=["imports"]).collect()
    assert [r.id for r in hits] == ["b"] and hits[0].evidence[0].type == "import"
    assert symbolic.exact_usage(table, ["collections", "math"], categories=["imports"]).count() == 0
    names = spark.createDataFrame([("sprint", "print"), ("MyClass", "myclass"), ("obj.print", "print"), (None, "x")], "n string, t string").collect()
    got = [spark.createDataFrame([(r.n,)], "n string").select(symbolic.matches(F.col("n"), r.t).alias("m")).first().m for r in names]
    assert got == [False, False, True, False]
    with pytest.raises(symbolic.Unsupported):
        symbolic.structural(records(spark), "show dependency graph", [])


def test_code_functions_survive_anything():
    deep = "x = " + "(" * 3000 + ")" * 3000
    for text in (None, "", "\0", deep, "é = 1", "def f(:\n"):
        assert set(code_functions.describe(text)) >= {"parsed", "calls"}
        assert isinstance(code_functions.signature(text), str) and isinstance(code_functions.canonical(text), str)
        assert code_functions.compact(text) is None if text is None else isinstance(code_functions.compact(text), str)
    assert code_functions.describe("class A:\n  @d(f())\n  def f(self, x=f()): other.f()")["recursive_functions"] == ["f"]


def version_rows(spark, rows):
    return spark.createDataFrame(rows, "logical_id string, version string, code string, arrival long, deleted boolean")


def test_versions_append_and_errors(spark):
    empty = spark.createDataFrame([], "logical_id string, version string, code string, append_seq long")
    rows = version_rows(spark, [("p", "r1", "a b c d e", 0, False), ("p", "r2", "a b c d f", 1, False), ("p", "r3", "", 2, True), ("p", "r3", "", 3, True), ("q", "r1", "x", 0, False)])
    new = versions.append(empty, rows).orderBy("logical_id", "append_seq").collect()
    assert [(r.logical_id, r.version, r.change_type, r.append_seq) for r in new] == [("p", "r1", "initial", 0), ("p", "r2", "substantial_update", 1), ("p", "r3", "deleted", 2), ("q", "r1", "initial", 0)]
    assert new[1].previous_similarity == pytest.approx(4 / 6) and new[2].previous_similarity == 0.0
    stored = spark.createDataFrame([(r.logical_id, r.version, r.code, r.append_seq) for r in new], empty.schema)
    assert versions.append(stored, rows).count() == 0
    with pytest.raises(versions.InvalidHistory):
        versions.append(stored, rows, strict=True)
    again = versions.append(stored, version_rows(spark, [("p", "r4", "a b c d e", 9, False)])).first()
    assert (again.change_type, again.append_seq) == ("substantial_update", 3)
    with pytest.raises(versions.InvalidHistory):
        versions.in_scope(stored.withColumn("change_type", F.lit("initial")), "yesterday", "append_seq")


def test_snapshots(spark):
    events = spark.createDataFrame([(0, "p", "r1"), (2, "p", "r2"), (3, "p", None), (1, "q", "s1")], "commit_ord int, path string, version string")
    got = {(r.commit_ord, r.path): r.version for r in versions.carry_forward(events, spark.range(5).select(F.col("id").cast("int").alias("commit_ord"))).collect()}
    assert got == {(0, "p"): "r1", (1, "p"): "r1", (2, "p"): "r2", **{(i, "q"): "s1" for i in range(1, 5)}}
    snap = spark.createDataFrame([(0, "c0", "p", "r1"), (2, "c2", "p", "r2")], "commit_ord int, commit string, logical_id string, version string")
    log = spark.createDataFrame([("p", "r1", "initial", 0), ("p", "r2", "unchanged", 1)], "logical_id string, version string, change_type string, append_seq int")
    scope = lambda s, c=None: [r.version for r in versions.in_scope(log, s, "append_seq", snap, c).collect()]
    assert scope("latest") == ["r2"] and scope("commit", "c0") == ["r1"] and sorted(scope("all")) == ["r1", "r2"]
    with pytest.raises(versions.InvalidHistory):
        scope("commit", "nope")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"a","title":"é","code":"x=1"}\n\n  \n{"id":"b"}\n')
    docs = io.read_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert sorted((r.id, r.title, r.retrieval_code) for r in docs.collect()) == [("a", "é", None), ("b", None, None)]
    (tmp_path / "bad.jsonl").write_text('{"id":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "d.json").write_text(json.dumps({"a": [1, 2]}, indent=1))
    assert io.read_json(spark, str(tmp_path / "d.json")).first().a == [1, 2]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [list(r.vec) for r in io.read_matrix_files(spark, str(tmp_path / "m.npy")).orderBy("pos").collect()] == [[0, 1], [2, 3], [4, 5]]
    np.arange(6, dtype="<f4").tofile(tmp_path / "v.f32")
    assert io.read_raw_vectors(spark, str(tmp_path / "v.f32"), 3).count() == 2
    with pytest.raises(Exception, match="within a row"):
        io.read_raw_vectors(spark, str(tmp_path / "v.f32"), 4).collect()
    with pytest.raises(Exception, match="finite"):
        io.valid_vectors(spark.createDataFrame([([1.0, float("nan")],)], "vec array<double>"), 2).collect()
    io.build_index(docs, str(tmp_path / "index"))
    with pytest.raises(Exception, match="(?i)already exists"):
        io.build_index(docs, str(tmp_path / "index"))
    io.append_rows(docs, str(tmp_path / "log"))
    io.append_rows(docs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert set(json.loads(io.manifest(spark, str(tmp_path / "c.jsonl"), n=2))) == {"n", "files"}


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for text in ("x = 1\n", "x = 2\n", None):
        if text is None:
            (tmp_path / "m.py").unlink()
        else:
            (tmp_path / "m.py").write_text(text)
        run("add", "-A")
        run("commit", "-qm", "c", "--allow-empty")
    spark.dataSource.register(GitSource)
    rows = spark.read.format("lexmill_git").option("path", str(tmp_path)).option("files", "m.py").load().orderBy("commit_ord").collect()
    assert [r.code for r in rows] == ["x = 1\n", "x = 2\n", None]
    for bad in ("/m.py", "../m.py", "m.txt"):
        with pytest.raises(ValueError):
            check_path(bad)


def test_encoding_resumes(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def model(texts):
            calls.add(len(texts))
            assert texts == sorted(texts, key=len, reverse=True)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    texts = spark.createDataFrame([(0, "a"), (1, "abcdef"), (2, "xy")], "id int, text string").coalesce(1)
    sig = encode.signature("model", 4)
    cache = spark.createDataFrame([], "id int, sig string, vec array<float>")
    first = encode.encode_missing(texts, cache, encode.encoder(make), sig, "id").collect()
    assert {r.id: r.vec[0] for r in first} == {0: 1.0, 1: 6.0, 2: 2.0} and calls.value == 3
    full = spark.createDataFrame(first, cache.schema)
    assert encode.encode_missing(texts, full, encode.encoder(make), sig, "id").count() == 0
    assert encode.encode_missing(texts, full, encode.encoder(make), encode.signature("other"), "id").count() == 3


def test_learned_fusion(spark):
    rng = np.random.default_rng(1)
    rows = [(q, d, float(x), float(y), int(x + y > 1)) for q in range(10) for d, (x, y) in enumerate(rng.random((20, 2)))]
    table = spark.createDataFrame(rows, "qid int, doc_id int, score double, other double, label int")
    model = learned.fit(table, ["score", "other"], rounds=5, least=5)
    out = learned.apply(model, table, ["score", "other"])
    assert out.where("(learned > 0.5) <> (label = 1)").count() < 20 and "blended" in out.columns


def test_scoring_goes_on_where_it_ended(spark, tmp_path):
    pairs = spark.createDataFrame([(q, d, "ask", "x" * d) for q in range(4) for d in range(10)], "qid int, doc_id int, query string, code string")
    scorer = encode.pair_scorer(lambda: lambda rows: [float(len(code)) for _, code in rows])
    path = str(tmp_path / "cache")
    run = lambda rows, sig: encode.score_in_steps(rows, path, scorer, sig, "qid", "doc_id", steps=3)
    assert run(pairs.where("qid < 2"), "m1") == 3 and run(pairs.where("qid < 2"), "m1") == 0
    assert run(pairs, "m1") == 3 and run(pairs, "m2") == 3
    got = spark.read.parquet(path)
    assert got.count() == 80 and got.where("score <> doc_id").count() == 0 and got.groupBy("qid", "doc_id", "sig").count().where("count > 1").count() == 0


def test_requests():
    assert Request("  find code  ").query == "find code"
    assert (Request("x", scope="commit:abc").scope, Request("x", scope="commit:abc").commit, Request("x", scope=None).scope) == ("commit", "abc", "auto")
    for bad in (("",), ("  ",), ("x", 0), ("x", 51), ("x" * 20_001,), ("x", 5, "yesterday"), ("x", 5, "commit"), ("x", 5, "commit:")):
        with pytest.raises(InvalidRequest):
            Request(*bad)
    assert (status(InvalidRequest()), status(Unavailable()), status(KeyError())) == (422, 503, 500)


def test_search(spark):
    corpus = sources(spark).withColumn("title", F.lit(""))
    vecs = spark.createDataFrame([("s1", [1.0, 0.0, 1.0, 0.0]), ("s2", [0.0, 1.0, 0.0, 1.0]), ("s3", [0.5, 0.5, 0.5, 0.5])], "id string, vec array<double>")
    log = versions.changes(spark.createDataFrame([("p", "r1", "a", 0, [1.0, 0.0]), ("p", "r2", "b", 1, [0.0, 1.0])], "logical_id string, version string, code string, append_seq int, vec array<double>"), "append_seq")
    engine = Engine(spark, corpus, records(spark), vecs, {"a": (0, 2), "b": (2, 4)}, {"a": 0.65, "b": 0.35}, log, None, lambda _: [1.0, 0.0, 1.0, 0.0])
    found = engine.search(Request("sorts a string"))
    assert found["plan"]["route"] == "semantic" and [r["id"] for r in found["results"]] == ["s1", "s3", "s2"] and found["results"][0]["code"]
    assert [r["id"] for r in engine.search(Request("which functions call range before print?"))["results"]] == ["s2"]
    assert [r["id"] for r in engine.search(Request("which files import os?"))["results"]] == ["s1"]
    hits = engine.search(Request("anything", scope="all"))["results"]
    assert [r["version"] for r in hits] == ["r1", "r2"] and len(hits[0]["timeline"]) == 2
    assert found["retrieval"]["reranker_triggered"] is False and found["retrieval"]["confidence_margin"] > 0 and [x["step"] for x in found["execution"]["steps"]] == ["plan", "semantic"]
    engine.scorer, engine.threshold = encode.pair_scorer(lambda: lambda pairs: [float(len(code)) for _, code in pairs]), 100.0
    again = engine.search(Request("sorts a string"))
    assert again["retrieval"]["reranker_triggered"] and again["results"][0]["id"] == "s1" and {r["id"]: r["score"] for r in again["results"]} == pytest.approx({r["id"]: r["score"] for r in found["results"]})
    engine.blend = 1.0
    assert [r["id"] for r in engine.search(Request("sorts a string", 2))["results"]] == ["s2", "s1"]  # by length of code alone
    engine.threshold = -1.0
    assert engine.search(Request("sorts a string"))["retrieval"]["reranker_triggered"] is False
    engine.corpus = corpus.where("id <> 's3'")
    with pytest.raises(Exception, match="no document s3"):
        engine.search(Request("sorts a string"))
    engine.corpus = corpus
    assert Engine(spark, corpus).search(Request("version history"))["execution"]["available"] is False
    with pytest.raises(Unavailable):
        Engine(spark, corpus).search(Request("sorts a string"))
    assert json.loads(main(["which", "files", "import", "os?"], engine))["results"]


def test_stream_appends_once(spark, tmp_path):
    arrive = lambda rows: version_rows(spark, rows).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("logical_id string, version string, code string, arrival long, deleted boolean").json(str(tmp_path / "in"))
    arrive([("p", "r1", "a b", 0, False)])
    append_stream(stream(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    arrive([("p", "r1", "a b", 1, False), ("p", "r2", "a b", 2, False)])
    append_stream(stream(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log")).orderBy("append_seq").collect()
    assert [(r.version, r.change_type, r.append_seq) for r in got] == [("r1", "initial", 0), ("r2", "unchanged", 1)]
