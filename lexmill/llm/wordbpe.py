"""BPE encoding and decoding for a word-end vocabulary, many words at once.

Texts are cut into pre-tokens by the classes of their code points, and equal pre-tokens
are found by rolling hashes, so that each is encoded once. The symbols of all new
pre-tokens stand in one flat array. A round finds adjacent pairs' ranks by binary
search over the sorted pair keys, merges the lowest-ranked pair of each word wherever
it stands, and retires the words that have no pair left. A round is exact because no
merge of this vocabulary has a lower rank than the merges that make its parts; loading
checks that.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import at_blanks, by_size, groups, map_texts, mix, prefix_hash, span_hash

#: Pre-tokens and ids that a process keeps from earlier batches; at the limit it starts anew.
CACHE_WORDS, CACHE_IDS = 1_000_000, 8_000_000

_NONE = np.int64(1) << 40
_BLANK, _LETTER, _NUMBER, _OTHER, _SPECIAL = range(5)
_SPECIALS_FROM = 0x110000

# Code points of the tokenizer's \s, and what its pattern splits off after an apostrophe.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _classes(specials: int) -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.full(_SPECIALS_FROM + specials, _SPECIAL, np.uint8)
    table[:_SPECIALS_FROM] = [kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)]
    table[_SPACES] = _BLANK
    return table


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of [starts, starts + lengths), one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special, self.special_ids = list(special), np.array(list(special.values()), np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        names = {i: t.encode() + b" " for t, i in (vocab | special).items()}
        self.size = max(names) + 1
        names = [names.get(i, b"") for i in range(self.size)]
        self.name_length = np.array([len(x) for x in names])
        self.name_start = np.cumsum(self.name_length) - self.name_length
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("merge order doesn't allow merging by rounds")
            made[a + b] = rank
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.ranks = np.append(np.arange(len(keys))[order], _NONE)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.kind = _classes(len(special))
        self.point_word = mix(np.arange(1, len(self.kind) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_start = np.zeros(0, np.int64)
        self.known_length = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.uint32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their n+1 offsets for n non-empty byte strings laid end to end."""
        n = len(offsets) - 1
        sym = self.inner[data]
        sym[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        start, word, pieces = offsets[:-1].copy(), np.arange(n), []
        # rk[i] ranks the pair (i, i+1); the last symbol of a word has none
        rk = np.full(len(sym), _NONE)
        inside = np.ones(len(sym), bool)
        inside[offsets[1:] - 1] = False
        i = np.flatnonzero(inside)
        rk[i] = self.rank(sym[i], sym[i + 1])
        while len(word):
            best = np.minimum.reduceat(rk, start)
            length = np.diff(np.append(start, len(sym)))
            going = best < _NONE
            if not going.all():
                stay = np.repeat(going, length)
                pieces.append((word[~going], length[~going], sym[~stay]))
                sym, rk, inside = sym[stay], rk[stay], inside[stay]
                word, best, length = word[going], best[going], length[going]
                if not len(word):
                    break
                start = np.cumsum(length) - length
            at = np.flatnonzero(rk == np.repeat(best, length))
            if len(at) > 1 and (np.diff(at) == 1).any():  # runs such as aaa: every second pair, from the left
                fresh = np.append(True, np.diff(at) != 1)
                nth = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[nth % 2 == 0]
            sym[at] = self.merged[rk[at]]
            inside[at] = inside[at + 1]
            rk[at] = _NONE
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            gone = np.cumsum(~keep)
            now = at - gone[at]
            start = start - np.where(start > 0, gone[start - 1], 0)
            sym, rk, inside = sym[keep], rk[keep], inside[keep]
            touched = np.concatenate([now, now[now > 0] - 1])
            rk[touched] = _NONE
            touched = touched[inside[touched]]
            rk[touched] = self.rank(sym[touched], sym[touched + 1])
        sizes = np.zeros(n, np.int64)
        for w, length, _ in pieces:
            sizes[w] = length
        ends = np.append(0, np.cumsum(sizes))
        out = np.zeros(ends[-1], np.int64)
        for w, length, s in pieces:
            out[ragged(ends[w], length)] = s
        return out, ends

    def points(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised code points of all texts, a line feed after each, and where each text ends."""
        clean, rare = [], {}
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" in text and self.split_special.search(text):
                rare[i] = [x if k % 2 else self.normal(x) for k, x in enumerate(self.split_special.split(text))]
                clean.append("".join("\0" if k % 2 else x for k, x in enumerate(rare[i])))
            else:
                clean.append(self.normal(text))
        ends = np.cumsum([len(x) + 1 for x in clean])
        points = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le"), np.uint32)
        if rare:
            points = points.copy()
            for i, runs in rare.items():
                at = ends[i] - len(clean[i]) - 1
                for k, x in enumerate(runs):
                    if k % 2:
                        points[at] = _SPECIALS_FROM + self.special.index(x)
                    at += 1 if k % 2 else len(x)
        return points, ends

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, without the word-final form of sigma, which the tokenizer does not use."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each pre-token."""
        kind = self.kind[points]
        change = np.ones(len(kind), bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= (kind == _NUMBER) | (kind == _SPECIAL)
        quote = np.flatnonzero((points == 39) & change)
        if len(quote):
            after = np.append(points, np.zeros(3, points.dtype))
            taken = np.zeros(len(quote), np.int64)
            for suffix in _SUFFIXES:
                hit = taken == 0
                for k, c in enumerate(suffix):
                    hit &= after[quote + 1 + k] == ord(c)
                taken[hit] = len(suffix)
            quote, taken = quote[taken > 0], taken[taken > 0]
            change[quote + 1] = False
            rest = quote + 1 + taken
            change[rest[rest < len(change)]] = True
        at = np.flatnonzero(change)
        ends = np.append(at[1:], len(points))
        own = kind[at] != _BLANK
        return at[own], ends[own]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n+1 offsets of the texts. Long ones are cut at blanks, which no token holds."""
        pieces, first = at_blanks(texts)
        if len(pieces) == len(texts):
            return self.encode_whole(texts)
        made = [self.encode_whole(pieces[a:b]) for a, b in by_size(pieces)]
        ends = np.append(0, np.cumsum(np.concatenate([np.diff(at) for _, at in made])))
        return np.concatenate([ids for ids, _ in made]), ends[first]

    def encode_whole(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        points, text_ends = self.points(texts)
        begin, end = self.spans(points)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        keys = span_hash(prefix_hash(self.point_word[points]), begin, end)
        distinct, first, which = unique(keys)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) + new.sum() > CACHE_WORDS or len(self.known_ids) > CACHE_IDS:
                self.forget()
                new[:] = True
            self.learn(distinct[new], points, begin[first[new]], end[first[new]])
            at = np.searchsorted(self.known, distinct)
        at = at[which]
        length = self.known_length[at]
        ids = self.known_ids[ragged(self.known_start[at], length)]
        total = np.append(0, np.cumsum(length))
        return ids, np.append(0, total[np.searchsorted(begin, text_ends)])

    def learn(self, keys: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode these pre-tokens and keep them."""
        special = points[begin] >= _SPECIALS_FROM
        length = np.ones(len(keys), np.int64)
        ids = np.zeros(0, np.int64)
        plain = np.flatnonzero(~special)
        if len(plain):
            size = (end - begin)[plain]
            own = points[ragged(begin[plain], size)]
            wide = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
            data = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids, ends = self.merge(data, np.append(0, np.cumsum(np.add.reduceat(wide, np.cumsum(size) - size))))
            length[plain] = np.diff(ends)
        start = np.cumsum(length) - length
        out = np.zeros(length.sum(), np.uint32)
        out[ragged(start[plain], length[plain])] = ids
        out[start[special]] = self.special_ids[points[begin[special]] - _SPECIALS_FROM]
        known = np.concatenate([self.known, keys])
        order = np.argsort(known)
        self.known = known[order]
        self.known_start = np.concatenate([self.known_start, start + len(self.known_ids)])[order]
        self.known_length = np.concatenate([self.known_length, length])[order]
        self.known_ids = np.concatenate([self.known_ids, out])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each text's token names, a blank between two."""
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = ids[a:b]
            out.append(self.name_bytes[ragged(self.name_start[own], self.name_length[own])].tobytes()[:-1])
        return out


def unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, one place of each, and which of them each key is."""
    order, fresh = groups(keys)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(keys))))
    return keys[order[fresh]], order[fresh], which


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again: n_tokens and hashes of ids and of decoded text.

    One row comes back for each row, repeated ids and texts included. Null and
    empty texts have no tokens and the hashes of an empty string. Other columns
    are not read, so their names don't matter. An empty table gives no rows.
    """

    def kernel(ids: pa.Array, texts: pa.Array) -> dict:
        bpe = load(path)
        got, offsets = bpe.encode(texts.to_pylist())
        raw, edges = got.astype("<u4").tobytes(), (4 * offsets).tolist()
        return {
            "doc_id": ids,
            "n_tokens": np.diff(offsets),
            "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in bpe.decode(got, offsets)],
        }

    kind = dict(df.dtypes)[id_col]
    return map_texts(df, kernel, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
