"""Whole queries over tables with odd rows, against the libraries and plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lexmill.llm import jaccard, langid, licenses, lm, media, packing, quality, queries, substrings, token_counts, wordbpe

SF = "/root/testdata/sf0.001"
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n\t "), (10**9 + 3, "x" * 9000), (10**9 + 4, "é " * 3000), (10**9 + 5, "a b\n" * 700), (10**9 + 5, "a b\n" * 700), (10**9 + 5, "other text of the same id"),
    (None, "a row without an id"), (None, "a row without an id"), (None, None), (10**9 + 6, "<|endoftext|> <s> </s> [PAD] ▁ a​b﻿c　d ﬁ"), (10**9 + 7, "#1 *2* $3 %4 & | < > \n\n same line\n same line\n"), (10**9 + 8, "\0\x01\x7f\x1c\x85"),
]


@pytest.fixture(scope="module")
def table(spark):
    """documents with odd rows, and columns named like what the operators make."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + ODD
    df = spark.createDataFrame(rows, docs.schema).selectExpr("doc_id", "text", "1 AS id", "2 AS n_tokens", "'x' AS part", "0.5 AS score", "true AS kept", "map('a', 1) AS length", "3 AS sequence_id", "'y' AS first", "4 AS key")
    return df.repartition(5), rows


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def plain_quality(key, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return key, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_quality(spark, table):
    df, rows = table
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.quality_rules(df).collect()
    same([tuple(r[c] for c in columns) for r in got], [plain_quality(*r) for r in rows])
    assert not any(r.kept and r.base_failed for r in got) and sum(r.kept for r in got) > 50
    assert quality.quality_rules(df.limit(0)).count() == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_round_trip(spark, table):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    df, rows = table

    def plain(key, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    same(wordbpe.round_trip(df, WORD_BPE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), [plain(*r) for r in rows])
    assert wordbpe.round_trip(df.limit(0), WORD_BPE).count() == 0


def test_token_counts(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    df, rows = table
    want = [(k, len((t or "").encode()), len(ids := model.encode(t or "")), len(ids) > 4096) for k, t in rows]
    same(token_counts.token_counts(df, PIECE_BPE).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect(), want)
    assert token_counts.token_counts(df.limit(0), PIECE_BPE).count() == 0


def test_packing(spark, table):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    df, rows = table
    want = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(key, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    got = packing.pack(df, WORD_BPE).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(w[3] for w in want) // 4096) + 2
    assert packing.pack(df.limit(0), WORD_BPE).count() == 0


def test_languages_of_odd_rows(spark, table):
    df, rows = table
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    both = df.join(lang, "doc_id", "left")
    got = langid.language_id(both).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    letters = {k: any(c.isalpha() for c in t or "") for k, t in rows if k is not None}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got if r.doc_id is not None) and all(0 <= r.score <= 1 for r in got)
    assert langid.keep_identified(both).columns == both.columns


def test_first_of_each_group_keeps_all_columns(spark, table):
    df, rows = table
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got[None] == 3 and max(n for k, n in got.items() if k is not None) == 1
    component = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(df.where("doc_id IS NOT NULL AND doc_id <> 1000000005")).collect()}
    assert {k for k in got if k is not None and k != 10**9 + 5} == {k for k, c in component.items() if k == c}


def test_a_long_text_through_every_operator(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(20_000)])
    long = "\n".join(" ".join(words[rng.integers(0, 20_000, 12)]) for _ in range(60_000)) + " under the MIT License"  # 4 MB
    assert len(long) > 4_000_000
    rows = [(1, long, "en"), (2, "short and sweet, " * 8, "en"), (4, long[100_000:], "en"), (5, "kurz und gut und kurz " * 5, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    n = {k: len(t.encode()) for k, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in lm.lm_scores(df, WORD_BPE).collect()} == {k: len(t.split()) + 1 for k, t, _ in rows}
    assert {r.doc_id: r.n_words for r in quality.quality_rules(df).collect()} == {k: len(t.split()) for k, t, _ in rows}
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(df).collect()}
    assert cut[1][:2] == (n[1], 0) and cut[4] == (n[4], n[4], 1)
    assert {r.doc_id: r.n_bytes for r in token_counts.token_counts(df, PIECE_BPE).collect()} == n
    classes = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(df).collect()}
    assert classes == {1: 1, 2: 2, 4: 1, 5: 5}
    assert {r.doc_id for r in langid.language_id(df).collect()} == set(n)
    assert {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}[1] == "mit"
    packed = packing.pack(df, WORD_BPE).collect()
    tokens = {r.doc_id: r.n_tokens for r in wordbpe.round_trip(df, WORD_BPE).collect()}
    assert all(sum(r.length for r in packed if r.doc_id == k) == tokens[k] + 1 for k in n)
    assert {r.doc_id: r.payload_bytes for r in media.media_digest(df).collect()} == {k: max(64, -(-x // 64) * 64) for k, x in n.items()}


def test_queries_are_named_by_their_numbers():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()} == set(range(1, 11))
