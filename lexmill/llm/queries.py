"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import jaccard, langid, licenses, lm, media, packing, quality, substrings, token_counts, wordbpe
from .common import documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


OP2_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir), WORD_BPE)


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(*OP2_COLUMNS)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.round_trip(documents(spark, sf_dir), WORD_BPE)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), PIECE_BPE)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir)).drop("class_id")


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_BPE)


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scores, op2_repetition_rules, op3_suffix_dedup, op4_bpe_round_trip, op5_token_counts, op6_jaccard_join, op6_jaccard_links, op7_language_id, op8_license_scan, op9_best_fit_packing, op10_mpeg_audio)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED)} ws FROM documents),
h AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) >= 5 THEN len(ws) - 3 WHEN len(ws) > 0 THEN 2 ELSE 1 END)) i FROM w)),
n AS (SELECT doc_id, count(*) n FROM h GROUP BY 1),
o AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM h x JOIN h y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT n_shingles, min(other) component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1"""

_LIMITS = ", ".join(f"({n}, {x})" for n, x in {**quality.TOP, **quality.DUPLICATED}.items())

OP2_SQL = f"""WITH w AS (SELECT doc_id, coalesce(text, '') text, {_WORDS.format('text')} ws FROM documents),
b AS (SELECT doc_id, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols FROM w),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, count(*) n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) chars FROM l WHERE nth > 1 GROUP BY 1),
g AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') s FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) i FROM w, (SELECT unnest(range(2, 11)) n))),
c AS (SELECT doc_id, n, i, s, count(*) OVER (PARTITION BY doc_id, n, s) times, row_number() OVER (PARTITION BY doc_id, n, s ORDER BY i) nth FROM g),
x AS (SELECT doc_id, n, times, nth, unnest(range(i, i + n)) pos FROM c WHERE times > 1 AND n >= 5),
r AS (SELECT doc_id, count(DISTINCT pos) n_repeat_words FROM x WHERE n = 8 GROUP BY 1),
u AS (SELECT y.doc_id, y.n, sum(length(w.ws[y.pos])) chars FROM (SELECT DISTINCT doc_id, n, pos FROM x WHERE nth > 1) y JOIN w USING (doc_id) GROUP BY 1, 2),
t AS (SELECT doc_id, n, max(times * length(replace(s, ' ', ''))) chars FROM c WHERE n <= 4 AND times >= {quality.TOP_COPIES} GROUP BY 1, 2),
m(n, most) AS (VALUES {_LIMITS}),
o AS (SELECT DISTINCT doc_id FROM (SELECT * FROM u UNION ALL SELECT * FROM t) JOIN m USING (n) JOIN b USING (doc_id) WHERE chars::DOUBLE / greatest(word_chars, 1) > most::DOUBLE),
f AS (SELECT b.*, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, coalesce(d.chars, 0)::DOUBLE / greatest(word_chars, 1) line_chars FROM b LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND line_chars <= {quality.LINE_CHARS} AND doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM f"""

OP3_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) i FROM d)),
f AS (SELECT s, min(doc_id) first FROM w GROUP BY 1),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) step FROM w JOIN f USING (s) WHERE first < doc_id),
t AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) span FROM g),
p AS (SELECT doc_id, span, min(i) a, max(i) + 50 b FROM t GROUP BY 1, 2),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) before FROM p),
k AS (SELECT doc_id, count(*) n_spans, sum(b - a) n_removed, max(b) last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) kept FROM e JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition_rules": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op6_jaccard_join": OP6_SQL}
