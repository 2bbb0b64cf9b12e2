"""Language identification by language-bitmask filters of character n-grams.

Every slot of the filter holds a bit per language and tier, so the AND of an n-gram's
slots tells which languages may contain it, and how often. The last tier has every n-gram
of a language's training texts. A text's share for a bit is that of its n-grams with
that bit, less what false positives of that bit's fill would give; a language's score is
the mean over its tiers.

The filter has the same number of slots at any size, so what is broadcast is bounded: a
last tier that fills up with the n-grams of a huge corpus tells less, and its correction
says so, while the upper ones hold at most 1 / tier n-grams a language.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_blanks, by_size, checkpoint, cut, keep_rows, mix, per_row, small_batches, tidy

#: Shares of a language's n-grams that an n-gram must have to belong to it; all belong to the last tier.
TIERS = (2.0**-12, 2.0**-15, 0.0)
#: Slots of a filter, slots that an n-gram sets, and chunks in which tasks' filters are joined.
SLOTS, PROBES, CHUNKS = 1 << 22, 3, 32
#: A pipeline rejects a text below this score.
LEAST = 0.2

_KIND: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for all else, by code point."""
    if not _KIND:
        value = {"L": 2, "M": 1}
        _KIND.append(np.array([value.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8))
    return _KIND[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """3- and 4-grams of words with a blank at either end, the text of each, and which texts have a letter.

    An n-gram is its code points, 16 bits each; those beyond 16 bits are folded.
    """
    clean = [(x or "").lower() for x in texts]
    ends = np.cumsum([0, *(len(x) + 1 for x in clean)])
    points = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le"), np.uint32)
    kind = _kind()[points]
    letters = per_row(kind == 2, ends) > 0
    c = np.zeros(len(points) + 4, np.uint64)
    c[1:-3] = np.where(kind > 0, (points ^ points >> 16) & 0xFFFF, 0)
    n = len(points)
    two = c[:n] << np.uint64(16) | c[1 : n + 1]
    three = two << np.uint64(16) | c[2 : n + 2]
    four = three << np.uint64(16) | c[3 : n + 3]
    at3 = np.flatnonzero(c[1 : n + 1])  # the middle is a letter
    at4 = at3[c[at3 + 2] > 0]
    of = np.repeat(np.arange(len(texts)), np.diff(ends))
    # a 3-gram has 48 bits; the upper ones tell it from a 4-gram that starts with a blank
    return np.concatenate([three[at3] | np.uint64(0xFFFF << 48), four[at4]]), np.concatenate([of[at3], of[at4]]), letters


def _word(bits: int) -> tuple[np.dtype, int]:
    """The smallest kind of number that holds so many bits, and how many of these."""
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if bits <= 8 * np.dtype(kind).itemsize:
            return np.dtype(kind), 1
    return np.dtype(np.uint64), -(-bits // 64)


@dataclass
class Filter:
    langs: list[str]
    tiers: int
    masks: np.ndarray  # a row a slot, with bits by language and tier
    wrong: np.ndarray  # a foreign n-gram's chance to pass, by bit

    @staticmethod
    def empty(langs: int, tiers: int, slots: int) -> np.ndarray:
        kind, words = _word(langs * tiers)
        return np.zeros((slots, words), kind)

    @staticmethod
    def add(masks: np.ndarray, keys: np.ndarray, bit: np.ndarray) -> None:
        """Set this bit of each n-gram's slots."""
        width = 8 * masks.itemsize
        for at in _slots(keys, len(masks)):
            for k in np.unique(bit).tolist():
                masks[at[bit == k], k // width] |= masks.dtype.type(1 << k % width)

    @staticmethod
    def of(langs: list[str], tiers: int, masks: np.ndarray) -> Filter:
        width = 8 * masks.itemsize
        fill = [np.count_nonzero(masks[:, k // width] >> masks.dtype.type(k % width) & masks.dtype.type(1)) / len(masks) for k in range(len(langs) * tiers)]
        return Filter(langs, tiers, masks, np.array(fill) ** PROBES)

    def counts(self, keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """N-grams of each text that have each bit."""
        order = np.argsort(of, kind="stable") if len(of) and (np.diff(of) < 0).any() else slice(None)
        keys, edges = keys[order], np.searchsorted(of[order], np.arange(n + 1))
        found = None
        for at in _slots(keys, len(self.masks)):
            found = self.masks[at] if found is None else found & self.masks[at]
        width = 8 * found.itemsize
        return np.stack([per_row(found[:, k // width] >> found.dtype.type(k % width) & found.dtype.type(1), edges) for k in range(len(self.wrong))], 1)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        pieces, first = at_blanks(texts)
        found, totals, lettered = [], [], []
        for a, b in by_size(pieces):
            keys, of, has = ngrams(pieces[a:b])
            found.append(self.counts(keys, of, b - a))
            totals.append(np.bincount(of, minlength=b - a))
            lettered.append(has)
        counts, total = np.add.reduceat(np.concatenate(found), first[:-1]), np.add.reduceat(np.concatenate(totals), first[:-1])
        letters = np.logical_or.reduceat(np.concatenate(lettered), first[:-1])
        total = np.maximum(total, 1)[:, None]
        share = np.where(self.wrong < 1, (counts / total - self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0)
        share = share.reshape(len(texts), len(self.langs), self.tiers).mean(2)
        best = share.argmax(1)  # of equal ones, the language with most training n-grams
        score = np.where(letters, np.clip(share[np.arange(len(texts)), best], 0, 1), 0)
        return [self.langs[b] if has else "und" for b, has in zip(best.tolist(), letters.tolist(), strict=True)], score


def _slots(keys: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = mix(keys)
    step = h >> np.uint64(32) | np.uint64(1)
    for _ in range(PROBES):
        yield (h & np.uint64(slots - 1)).astype(np.int64)
        h = h + step


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", tiers: tuple[float, ...] = TIERS, slots: int = SLOTS) -> Filter:
    """A filter of all n-grams of all rows with a language and a text; its size is `slots` times the bits of languages and tiers.

    N-grams are counted by language in one shuffle. Each task of the next step sets the bits
    of those that it has, and chunks of the tasks' filters are joined bit by bit on
    executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                langs, which = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                pieces, first = at_blanks(part.column(1).to_pylist())
                which = np.repeat(which, np.diff(first))
                for a, b in by_size(pieces):
                    keys, of, _ = ngrams(pieces[a:b])
                    for k, lang in enumerate(langs):
                        gram, n = np.unique(keys[which[a:b][of] == k], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram.view(np.int64), "n": n})

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts)
    total = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row a language
    langs = sorted(total, key=lambda x: (-total[x], x))
    if not langs:
        return Filter.of([], len(tiers), Filter.empty(0, len(tiers), slots))
    number = {x: k for k, x in enumerate(langs)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = None
        for batch in batches:
            masks = Filter.empty(len(langs), len(tiers), slots) if masks is None else masks
            names = batch.column(0).dictionary_encode()
            code = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
            share = batch.column(2).to_numpy() / np.array([total[x] for x in langs])[code]
            for k, least in enumerate(tiers):
                has = share >= least
                Filter.add(masks, batch.column(1).to_numpy()[has].view(np.uint64), code[has] * len(tiers) + k)
        if masks is not None:
            for k, chunk in enumerate(np.array_split(masks, CHUNKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(chunk.tobytes(), 1)], pa.binary())], names=["chunk", "masks"])

    kind, words = _word(len(langs) * len(tiers))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(data), kind)
                joined[k] = joined[k] | own if k in joined else own
        for k, own in joined.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "masks"])

    chunks = counts.mapInArrow(tidy(fill), "chunk int, masks binary").repartitionById(CHUNKS, "chunk").mapInArrow(tidy(join), "chunk int, masks binary")
    got = sorted(chunks.collect(), key=lambda r: r.chunk)  # CHUNKS rows, the whole filter
    return Filter.of(langs, len(tiers), np.frombuffer(b"".join(r.masks for r in got), kind).reshape(slots, words))


def identify(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    A text that is null or has no letter is `und` with score 0, and so is any text if no
    language was learned. Rows may repeat. Other columns are not read. An empty table
    gives no rows.
    """
    shared = small_batches(df.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                langs, score = shared.value.decide(part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang_pred": pa.array(langs, pa.string()), "score": score})

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def fold(column: str, by: int) -> F.Column:
    """crc32 of an id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % by


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows of two folds of three that have a language, and predict every row's.

    Returns doc_id, held_out, lang_pred, score; see identify(). A row with a null id
    is neither held out nor learned from.
    """
    held = fold(id_col, 3) == 1
    model = learn(df.where(~held), text_col, lang_col)
    return identify(df, model, id_col, text_col).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, whose language language_id() tells with a score of `least` or more.

    If no row has a language to learn from, nothing can be rejected and all rows stay.
    """
    model = learn(df.where(fold(id_col, 3) != 1), text_col, lang_col)
    if not model.langs:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    return keep_rows(df, lambda texts: shared.value.decide(texts.to_pylist())[1] >= least, text_col)
