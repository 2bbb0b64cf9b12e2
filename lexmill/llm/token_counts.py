"""Token counts of long texts, by the byte-fallback piece vocabulary's own library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import flat, map_texts

#: Longest run handed to the encoder when a safe boundary allows it.
CHUNK_CHARS = 2048

_LOADED: dict = {}

# A blank between two other characters. No piece holds the blank's mark after another
# character (checked on loading), so no merge crosses it; the encoder's own leading mark
# stands for the blank that the cut removes.
_SAFE = regex.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def load(path: str):
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if mark in piece.lstrip(mark):
                raise ValueError("a piece crosses a word boundary")
        if model.encode("a a") != model.encode("a") * 2:
            raise ValueError("this vocabulary doesn't mark a text's start as a blank")
        _LOADED[path] = model
    return _LOADED[path]


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Cut a text at safe blanks, one after each `size` characters at the earliest."""
    out, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit of every text.

    Batches hold about as many bytes each, and only lengths leave Python. One row
    comes back for each row, repeated ids and texts included; null and empty texts
    count 0 bytes and 0 tokens. Other columns are not read. An empty table gives no rows.
    """

    def kernel(ids: pa.Array, texts: pa.Array) -> dict:
        model = load(path)
        parts, of = [], []
        for i, text in enumerate(texts.to_pylist()):
            if text:
                cut = chunks(text)
                parts += cut
                of += [i] * len(cut)
        sizes = [len(x) for x in model.encode(parts, num_threads=1)] if parts else []
        n = np.bincount(np.array(of, np.int64), weights=np.array(sizes, float), minlength=len(texts)).astype(np.int64)
        return {"doc_id": ids, "n_bytes": np.diff(flat(texts)[1]), "n_tokens": n, "over_limit": n > limit}

    kind = dict(df.dtypes)[id_col]
    return map_texts(df, kernel, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col, max_bytes=1 << 20)
