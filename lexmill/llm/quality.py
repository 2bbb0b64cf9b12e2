"""Repetition rules: characters inside duplicated n-grams and lines, by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_WORD, WHITE, flat, groups, keep_rows, map_texts, per_row, prefix_hash, span_hash, text_salt, word_spans

#: Largest share of characters inside later copies of n-grams, by n, and of one n-gram's copies.
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of characters in later copies of lines. There is no limit on their number: one of three may repeat.
LINE_CHARS = 0.20
#: Copies that a top n-gram needs before its share counts, so that short texts don't fail by chance.
TOP_COPIES = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_WORD_ODD = 0xC2B2AE3D27D4EB4F


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any window of n words that starts at one of these places."""
    total = np.cumsum(np.bincount(at, minlength=size))[:size]
    total[n:] -= total[:-n].copy()
    return total > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text, and the shares of repeated characters."""
    n_texts = len(offsets) - 1
    starts, ends, word_at = word_spans(data, offsets)
    n_words = np.diff(word_at)
    of = np.repeat(np.arange(n_texts), n_words)
    points = np.append(0, np.cumsum(~WHITE[data] & (data & 0xC0 != 0x80)))
    size = points[ends] - points[starts]
    word_chars = per_row(size, word_at)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_row(_SYMBOL[data], offsets)}

    prefix = prefix_hash(BYTE_WORD[data])
    salt = text_salt(n_texts)
    total = np.maximum(word_chars, 1)

    # lines that hold a word
    breaks = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    first = first[first < len(data)]
    over = np.minimum(np.append(first[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, first)]) if len(first) else first
    with_word = np.searchsorted(starts, over) > np.searchsorted(starts, first)
    first, over = first[with_word], over[with_word]
    line_of = np.searchsorted(offsets, first, "right") - 1
    again = _later(span_hash(prefix, first, over) ^ salt[line_of]) if len(first) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=n_texts)
    in_line = points[over] - points[first]
    out["dup_line_chars"] = np.bincount(line_of[again], in_line[again], n_texts) / total

    # n-grams: those of n+1 words can only repeat where those of n words do
    words = prefix_hash(span_hash(prefix, starts, ends), _WORD_ODD) if len(starts) else np.zeros(1, np.uint64)
    at = np.arange(len(starts))
    room = word_at[1:][of] - at
    out["n_repeat_words"] = np.zeros(n_texts, np.int64)
    for n in range(2, 11):
        at = at[room[at] >= n]
        later = np.zeros(0, np.int64)
        if len(at):
            order, fresh = groups(span_hash(words, at, at + n, _WORD_ODD) ^ salt[of[at]])
            count = np.diff(np.append(fresh, len(at)))
            repeated = np.repeat(count > 1, count)
            if n in TOP:
                head = at[order[fresh]]
                chars = np.cumsum(np.append(0, size))
                share = np.where(count >= TOP_COPIES, count * (chars[head + n] - chars[head]), 0) / total[of[head]]
                best = np.zeros(n_texts)
                np.maximum.at(best, of[head], share)
                out[f"top_{n}"] = np.minimum(best, 1)
            lead = np.zeros(len(at), bool)
            lead[fresh] = True
            later = np.sort(at[order[repeated & ~lead]])
            at = np.sort(at[order[repeated]])
        elif n in TOP:
            out[f"top_{n}"] = np.zeros(n_texts)
        if n == 8:
            out["n_repeat_words"] = np.bincount(of[_covered(at, 8, len(starts))], minlength=n_texts) if len(starts) else out["n_repeat_words"]
        if n in DUPLICATED:
            inside = _covered(later, n, len(starts))
            out[f"dup_{n}"] = np.bincount(of[inside], size[inside], n_texts) / total
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys stand earlier already."""
    order, fresh = groups(keys)
    again = np.ones(len(keys), bool)
    again[order[fresh]] = False
    return again


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    good = m["dup_line_chars"] <= LINE_CHARS
    for n, most in TOP.items():
        good &= m[f"top_{n}"] <= most
    for n, most in DUPLICATED.items():
        good &= m[f"dup_{n}"] <= most
    return failed, ~failed & good


_SHARES = [*(f"top_{n}" for n in TOP), *(f"dup_{n}" for n in DUPLICATED), "dup_line_chars"]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word, symbol, line and repetition counts of every text, base_failed, kept and the measured shares.

    One row comes back for each row, repeated ids and texts included. Null and empty
    texts have no words, so they fail. A text of any length is measured whole. Other
    columns are not read. An empty table gives no rows.
    """

    def kernel(ids: pa.Array, texts: pa.Array) -> dict:
        m = measure(*flat(texts))
        failed, kept = verdict(m)
        counts = {k: m[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return {"doc_id": ids, **counts, "base_failed": failed, "kept": kept, **{k: m[k].astype(float) for k in _SHARES}}

    kind = dict(df.dtypes)[id_col]
    shares = ", ".join(f"{k} double" for k in _SHARES)
    return map_texts(df, kernel, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, {shares}", id_col, text_col)


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that quality_rules() keeps, with all their columns."""
    return keep_rows(df, lambda texts: verdict(measure(*flat(texts)))[1], text_col)
