import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import langid, queries


def plain_ngrams(text: str) -> list[str]:
    """By hand: words of letters and marks, a blank at either end."""
    import unicodedata

    spaced = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    padded = [f" {w} " for w in spaced.split()]
    return [w[i : i + n] for n in (3, 4) for w in padded for i in range(len(w) - n + 1)]


def test_ngrams_against_plain_python():
    texts = ["The cat, the DOG", "", None, "x", "été 日本", "1 2 3", "ab\ncd", "tail"]
    keys, of, letters = langid.ngrams(texts)
    for i, text in enumerate(texts):
        want = plain_ngrams(text)
        assert (of == i).sum() == len(want)
        assert len(set(keys[of == i].tolist())) == len(set(want))
    assert letters.tolist() == [True, False, False, True, True, False, True, True]


def built(langs: list[str], keys: np.ndarray, lang: np.ndarray, slots: int = 1 << 16) -> langid.Filter:
    masks = langid.Filter.empty(len(langs), 1, slots)
    langid.Filter.add(masks, keys, lang)
    return langid.Filter.of(langs, 1, masks)


def test_filter_counts_and_correction():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 1 << 62, 3000).astype(np.uint64) for _ in range(3)]
    model = built(["a", "b", "c"], np.concatenate(keys), np.repeat([0, 1, 2], 3000))
    foreign = rng.integers(0, 1 << 62, 100_000).astype(np.uint64)
    for k in range(3):
        counts = model.counts(keys[k], np.zeros(3000, np.int64), 1)[0]
        assert counts[k] == 3000
        others = [j for j in range(3) if j != k]
        assert all(counts[j] <= 40 for j in others)
    counts = model.counts(foreign, np.zeros(len(foreign), np.int64), 1)[0]
    assert counts / len(foreign) == pytest.approx(model.wrong, abs=0.002)


def test_a_full_filter_decides_nothing():
    keys = np.arange(70_000, dtype=np.uint64)
    model = built(["a"], keys, np.zeros(70_000, np.int64), 1 << 10)
    assert model.wrong.tolist() == [1.0] and model.decide(["any text at all"]) == (["a"], np.zeros(1))


def test_many_languages_need_more_words():
    keys = np.arange(70_000, dtype=np.uint64)
    model = built([f"l{k}" for k in range(70)], keys, np.repeat(np.arange(70), 1000))
    assert model.masks.shape[1] == 2
    assert model.counts(keys[69_000:], np.zeros(1000, np.int64), 1)[0].argmax() == 69


def held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def plain_scores(rows: list[tuple], texts: list[str]) -> list[tuple[str, float]]:
    """By counters of n-grams, without a filter, for each text: language and score."""
    count: dict[str, Counter] = {}
    for key, text, lang in rows:
        if key is not None and not held(key) and text is not None and lang is not None:
            count.setdefault(lang, Counter()).update(plain_ngrams(text))
    total = {x: sum(c.values()) for x, c in count.items()}
    langs = sorted(total, key=lambda x: (-total[x], x))
    out = []
    for text in texts:
        grams = plain_ngrams(text)
        if not grams:
            out.append(("und", 0.0))
            continue
        share = {x: np.mean([sum(count[x][g] > 0 and count[x][g] / total[x] >= t for g in grams) / len(grams) for t in langid.TIERS]) for x in langs}
        best = max(langs, key=lambda x: share[x])
        out.append((best, share[best]))
    return out


def test_documents_against_counters(spark):
    """All n-grams of all training texts count; the filter's own false positives are within its correction."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r.doc_id: r for r in queries.op7_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    want = plain_scores(rows, [t for _, t, _ in rows])
    assert all(got[k].held_out == held(k) for k, *_ in rows)
    assert max(abs(got[k].score - s) for (k, *_), (_, s) in zip(rows, want, strict=True)) < 0.01
    assert sum(got[k].lang_pred != x for (k, *_), (x, _) in zip(rows, want, strict=True)) == 0


def test_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en"), (10**9 + 1, "", None), (10**9 + 2, "12 34", "en"), (None, "the and of", "en")], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd).unionByName(docs.limit(1).select("doc_id", "text", "lang"))
    got = langid.language_id(rows.withColumn("score", rows.lang)).collect()
    assert len(got) == docs.count() + 5
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.99 * len(held)
    und = {r.doc_id: r.score for r in got if r.lang_pred == "und"}
    assert und == {10**9: 0.0, 10**9 + 1: 0.0, 10**9 + 2: 0.0}
    assert langid.language_id(docs.limit(0)).count() == 0
