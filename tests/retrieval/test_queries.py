"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
import re

import duckdb
import pytest

from lexmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    value = value.tolist() if hasattr(value, "tolist") else value
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    answer = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(answer.fetchall(), columns)


COUNTED = "fusion_weight_grid grid_argmax rrf_fusion rrf_weight_grid structural_weight_fusion rank_strict_count rank_buckets failure_buckets missing_as_101 recall_by_depth rank_summary ndcg_mrr_recall gating_capture worst_failures paired_bootstrap".split()


@pytest.mark.parametrize("name", COUNTED)
def test_scores_of_all_pairs_are_no_rows(spark, monkeypatch, name):
    def rows(*_, **__):
        raise AssertionError("scores of all pairs as rows")

    monkeypatch.setattr(registry.dense, "scores", rows)
    assert registry.queries()[name](spark, SF).count() > 0


def test_standard_scores_are_not_shuffled(spark):
    assert "Exchange" not in registry.queries()["zscores"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_relevant_is_the_next_of_its_label(spark, tmp_path):
    rows = [(0, 1), (0, 2), (5, None), (100, 1), (100, 1), (150, 2), (200, 1), (201, 1), (300, 3), (None, 3), (400, None)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, registry.relevant(spark, str(tmp_path)).collect())) == [(0, 100), (100, 200), (200, 201)]


def test_previews_of_great_ids(spark, duck, tmp_path):
    ids = [0, 1, 499, 500, 501, 1001, 7_200_000, 2**31 - 1, 2**31 + 5, 2**40]
    spark.createDataFrame([(i,) for i in ids], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    want = duck.execute(registry.oracle_sql()["short_fingerprints"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, registry.queries()["short_fingerprints"](spark, str(tmp_path)).collect())) == sorted(want)


def test_bootstrap_interval(spark):
    r = registry.queries()["paired_bootstrap"](spark, SF).first()
    assert r.low <= r.mean <= r.high and math.isfinite(r.mean)


def test_bootstrap_takes_the_operators_rounds(spark, monkeypatch):
    seen, bootstrap = [], registry.metrics.bootstrap
    monkeypatch.setattr(registry.metrics, "bootstrap", lambda deltas, rounds=2000, seed=7: seen.append(rounds) or bootstrap(deltas, rounds, seed))
    registry.queries()["paired_bootstrap"](spark, SF)
    assert seen == [2000]


def test_benchmark_terms_against_python(spark):
    from lexmill.functions.text import STOPWORDS

    texts = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {r.item_id: list(dict.fromkeys(w for w in re.findall(r"\b[A-Za-z_][A-Za-z0-9_.]*\b", r.text) if w.lower() not in STOPWORDS))[:12] for r in texts}
    assert {r.qid: r.terms for r in registry.queries()["benchmark_term_lists"](spark, SF).collect()} == want
