import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import attention, lm
from lexmill.llm.queries import WORD_BPE


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    tree = attention.Tree.build(rng.integers(0, 50, 40))
    p = {k: v.astype(np.float64) for k, v in attention.new_params(40, tree.bias, 8).items()}
    p["node"] += rng.standard_normal(p["node"].shape) * 0.3
    p["near"] += rng.standard_normal(p["near"].shape) * 0.3
    return p, tree


def plain_log_prob(p, tree, tokens: list[int], end: int) -> float:
    """Token by token, from the definition: attend to the own block so far and the block before."""
    inputs, targets, total = [end, *tokens], [*tokens, end], 0.0
    for t, goal in enumerate(targets):
        seen = range(max(0, (t // attention.BLOCK - 1) * attention.BLOCK), t + 1)
        x = p["embed"][inputs[t]]
        logits = np.array([(x @ p["query"]) @ (p["embed"][inputs[j]] @ p["key"]) / math.sqrt(len(x)) + p["near"][t - j] for j in seen])
        w = np.exp(logits) / np.exp(logits).sum()
        h = x + sum(a * (p["embed"][inputs[j]] @ p["value"]) for a, j in zip(w, seen, strict=True)) @ p["out"]
        for k in range(tree.start[goal], tree.start[goal + 1]):
            z = tree.side[k] * (p["node"][tree.node[k]] @ h + p["bias"][tree.node[k]])
            total += -math.log1p(math.exp(-z))
    return total


def test_scores_against_plain_python(small):
    p, tree = small
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 39, n).tolist() for n in (0, 1, 15, 16, 17, 31, 32, 33, 70)]
    ids = np.array([x for t in texts for x in t])
    inputs, target, of, _ = attention.blocks_of(ids, np.append(0, np.cumsum([len(t) for t in texts])), 39)
    assert (target >= 0).sum() == len(ids) + len(texts)  # each once
    got = np.bincount(of, attention.log_prob(p, tree, inputs, target, 3))
    assert got == pytest.approx([plain_log_prob(p, tree, t, 39) for t in texts], rel=1e-6)


def test_probabilities_sum_to_one(small):
    p, tree = small
    inputs = np.full((40, 2 * attention.BLOCK), -1)
    inputs[:, attention.BLOCK] = 39
    target = np.full((40, attention.BLOCK), -1)
    target[:, 0] = np.arange(40)
    assert np.exp(attention.log_prob(p, tree, inputs, target)).sum() == pytest.approx(1)


def test_gradients(small):
    p, tree = small
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 39, 90)
    inputs, target, _, _ = attention.blocks_of(ids, np.array([0, 50, 90]), 39)
    trainer = attention.Trainer(p, tree)
    _, g = trainer.gradients(inputs, target)
    n = (target >= 0).sum()
    for name, grad in g.items():
        if isinstance(grad, tuple):
            full = np.zeros(p[name].shape)
            full[grad[0]] = grad[1][:, 0] if name == "bias" else grad[1]
            grad = full
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in grad.shape)
            value, step = trainer.p[name][at], 1e-5
            trainer.p[name][at] = value + step
            up = trainer.gradients(inputs, target)[0]
            trainer.p[name][at] = value - step
            down = trainer.gradients(inputs, target)[0]
            trainer.p[name][at] = value
            assert grad[at] == pytest.approx((up - down) / (2 * step) * n, rel=1e-3, abs=1e-5)


def test_training_helps(small):
    _, tree = small
    ids = np.tile(np.array([3, 7, 1, 9, 30, 2]), 3000)
    inputs, target, _, _ = attention.blocks_of(ids, np.array([0, len(ids)]), 39)
    trainer = attention.Trainer(attention.new_params(40, tree.bias, 8), tree, 0.2)
    before = -attention.log_prob(trainer.p, tree, inputs, target).sum() / len(ids)
    trainer.learn(inputs, target, 16)
    assert -attention.log_prob(trainer.p, tree, inputs, target).sum() / len(ids) < 0.2 * before


def test_base_against_plain_python_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "never seen wörd"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "the the")], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(2))
    table = [(r.doc_id, r.text) for r in rows.collect()]
    got = lm.lm_scores(rows.selectExpr("doc_id", "text", "1 AS key", "2 AS score", "3 AS block"), WORD_BPE).collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for _, t in table]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in table]
    count = Counter(w for (k, _), h, ws in zip(table, held, words, strict=True) if not h and k is not None for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = [(k, h, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for (k, _), h, ws in zip(table, held, words, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got)
    assert all(r.score < 0 for r in got)
    per_doc = {}
    for r in got:
        per_doc.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert all(len(x) == 1 for x in per_doc.values())
    assert lm.lm_scores(docs.limit(0), WORD_BPE).count() == 0


def keyed(spark, texts):
    rows = [(i, t, i % 5 == 4, i % 5 != 4, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, trains boolean, key long")


def test_every_training_text_reaches_the_trainers(spark):
    texts = [f"word{i} {chr(97 + i % 26) * 3} {i * 37}" for i in range(60)] + ["a longer text " * 30, "", None]
    params, tree = lm.train(lm.stored_texts(keyed(spark, texts).repartition(3), WORD_BPE), WORD_BPE)
    bpe = lm.load(WORD_BPE)
    above = lambda rows: tree.node[tree.start[np.unique(bpe.encode(rows)[0])]]  # the inner node above each token
    trained = np.abs(params["node"]).sum(1) > 0
    assert trained[above([t for i, t in enumerate(texts) if i % 5 != 4])].all()
    assert not trained[above(["zebra crossing xylophone"])].all()


def test_stored_texts_hold_all_tokens(spark):
    texts = ["one", "two words here", "", None, "long " * 100, "last one"]
    got = lm.stored_texts(keyed(spark, texts).coalesce(1), WORD_BPE).collect()
    bpe = lm.load(WORD_BPE)
    want, offsets = bpe.encode(texts)
    pieces = [lm._restore(r.ids, bpe.size) for r in got if r.ids is not None]
    assert np.concatenate([x[0] for x in pieces]).tolist() == want.tolist()
    assert np.concatenate([np.diff(x[1]) for x in pieces]).tolist() == np.diff(offsets).tolist()
    assert np.concatenate([x[2] for x in pieces]).tolist() == list(range(6)) and np.concatenate([x[3] for x in pieces]).tolist() == [True] * 4 + [False, True]
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted((r for r in got if r.counts is not None), key=lambda r: -r.part)])
    assert counts.sum() == len(want) - (offsets[5] - offsets[4]) + 5
    assert [r.n_tokens for r in got if r.n_tokens is not None] == [2, 4, 1, 1, 101, 3]


def test_frequent_words_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    base = lambda: {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.lm_scores(docs, WORD_BPE).collect()}
    some = base()
    monkeypatch.setattr(lm, "FREQUENT", 1.0)
    assert base() == some
    monkeypatch.setattr(lm, "FREQUENT", 0.0)
    assert base() == some


def test_probabilities_far_from_even(small):
    """Without clamps: paths of any steepness and attention of any sharpness."""
    p, tree = small
    steep = {k: v * (60 if k in ("node", "query") else 1) for k, v in p.items()}
    inputs = np.full((40, 2 * attention.BLOCK), -1)
    inputs[:, attention.BLOCK] = 39
    target = np.full((40, attention.BLOCK), -1)
    target[:, 0] = np.arange(40)
    assert np.exp(attention.log_prob(steep, tree, inputs, target)).sum() == pytest.approx(1)


def test_parameters_add_up_in_any_number_of_steps(spark, monkeypatch):
    texts = [f"word{i} {chr(97 + i % 26) * 3} {i * 37} some more of the same" for i in range(300)]
    stored = lm.stored_texts(keyed(spark, texts).repartition(5), WORD_BPE).cache()
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 150)
    whole, _ = lm.train(stored, WORD_BPE)
    monkeypatch.setattr(lm, "FAN", 2)
    steps, _ = lm.train(stored, WORD_BPE)
    assert all(np.abs(whole[k] - steps[k]).max() < 1e-4 for k in whole)
    assert np.abs(whole["node"]).sum() > 1
    stored.unpersist()


@pytest.mark.parametrize("dim", [8, 7])
def test_steps_near_the_root_and_below(monkeypatch, dim):
    """Products with all nodes near the root and with single nodes below give the same scores and gradients."""
    rng = np.random.default_rng(3)
    tree = attention.Tree.build(rng.integers(0, 1000, 300) ** 3)
    p = {k: v.astype(np.float64) for k, v in attention.new_params(300, tree.bias, dim).items()}
    p["node"] += rng.standard_normal(p["node"].shape) * 0.3
    ids = rng.integers(0, 299, 200)
    inputs, target, _, _ = attention.blocks_of(ids, np.array([0, 90, 90, 200]), 299)
    want = plain_log_prob(p, tree, ids[:90].tolist(), 299) + plain_log_prob(p, tree, [], 299) + plain_log_prob(p, tree, ids[90:].tolist(), 299)
    full = []
    for top in (1, 20, 1000):
        monkeypatch.setattr(attention, "TOP", top)
        assert attention.log_prob(p, tree, inputs, target).sum() == pytest.approx(want)
        _, g = attention.Trainer(p, tree).gradients(inputs, target)
        each = {}
        for name, grad in g.items():
            if isinstance(grad, tuple):
                assert len(np.unique(grad[0])) == len(grad[0])
                each[name], each[name + " count"] = np.zeros(p[name].shape), np.zeros(len(p[name]))
                each[name][grad[0]], each[name + " count"][grad[0]] = grad[1][:, 0] if name == "bias" else grad[1], grad[2]
            else:
                each[name] = grad
        full.append(each)
    assert all(one[k] == pytest.approx(full[0][k], rel=1e-9, abs=1e-12) for one in full for k in one)


def test_sums_go_home_in_few_blocks(monkeypatch):
    """A block a part and not one for every few texts; a text's sums may come in several pieces."""
    rng = np.random.default_rng(4)
    pieces = [(np.sort(rng.integers(0, 500, 30)), rng.integers(0, 9, 30).astype(np.uint64), rng.standard_normal(30), rng.standard_normal(30)) for _ in range(100)]
    for most, blocks in ((1 << 17, 4), (1000, 12)):
        monkeypatch.setattr(lm, "TEXTS", most)
        sums = lm._Sums(4)
        got = [b for p in pieces for b in sums.add(*p)] + list(sums.rest()) + list(sums.rest())
        assert len(got) == blocks
        columns, key, _ = zip(*(lm.read_block(x, 3) for b in got for x in b.column(1).to_pylist()), strict=True)
        key = np.concatenate(key)
        known, base, score = (np.concatenate([c[k] for c in columns]) for k in range(3))
        for own, want in ((known, 1), (lm._floats(base), 2), (lm._floats(score), 3)):
            assert np.bincount(key, own, 500) == pytest.approx(np.bincount(np.concatenate([p[0] for p in pieces]), np.concatenate([p[want] for p in pieces]), 500))
