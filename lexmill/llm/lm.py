"""Language-model scores of all texts, with a unigram baseline from the whole corpus.

1. One pass over the texts turns each into subword ids and counted words, which are stored.
   The counts of training ids, over all of them, shape the output tree.
2. Trainers, one for each TRAINER_TOKENS, start from shared parameters and pass once over a
   share of the training texts, every block of every text; their parameters are averaged
   row by row, weighted by how often a row was seen. A quarter of the shares gives the
   start for the rest, at every size.
3. The stored ids are scored. Words are counted within each task before their counts meet in
   fragments by hash. The counts of words that are a large share of all, at most
   1 / FREQUENT of them, go back to all tasks; only the other words of each text travel to
   their fragments. Sums return to their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .blocks import BLOCKS, home, read_block, receive, send, write_block
from .common import BYTE_WORD, LOWER, Scratch, at_blanks, by_size, checkpoint, cut, flat, groups, prefix_hash, release, small_batches, span_hash, text_salt, tidy, word_spans
from .langid import fold
from .wordbpe import load

#: Training tokens for each trainer.
TRAINER_TOKENS = 2_000_000
#: Pieces in which a batch of texts is stored, so that trainers get even shares.
PIECES = 16
#: Width of the model, and chunks in which parameters and counts are summed.
DIM, CHUNKS = 16, 16
#: Words that a task gathers before it writes a block for each fragment.
BLOCK_ROWS = 1_200_000
#: Texts whose sums a task gathers before it sends a block to each part: a block for every few texts costs more than its sums.
TEXTS = 1 << 17
#: Share of all words from which a word counts as frequent.
FREQUENT = 2.0**-17
_ZSTD = pa.Codec("zstd", compression_level=1)

_LOWER = np.frombuffer(LOWER, np.uint8)
_SMALL = "part int, block binary"
#: Trainers whose parameters one task adds up.
FAN = 64
_DENSE = ("query", "key", "value", "out", "near")


def _row(part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "block"])


def _store(ids: np.ndarray, offsets: np.ndarray, key: np.ndarray, trains: np.ndarray, size: int) -> bytes:
    """Subword ids of texts, behind the number of texts and the length, the key and the use of each."""
    body = b"".join([np.diff(offsets).astype("<u4").tobytes(), key.astype("<i8").tobytes(), trains.astype(np.uint8).tobytes(), ids.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()])
    return np.array([len(key), len(body)], "<u8").tobytes() + _ZSTD.compress(body, asbytes=True)


def _restore(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and offsets of the texts, their keys and whether they train."""
    n, length = (int(x) for x in np.frombuffer(data, "<u8", 2))
    body = _ZSTD.decompress(memoryview(data)[16:], length, asbytes=True)
    sizes, key = np.frombuffer(body, "<u4", n), np.frombuffer(body, "<i8", n, 4 * n)
    ids = np.frombuffer(body, "<u2" if size <= 1 << 16 else "<u4", offset=13 * n)
    return ids.astype(np.int64), np.append(0, np.cumsum(sizes, dtype=np.int64)), key, np.frombuffer(body, np.uint8, n, 12 * n).astype(bool)


_STORED = "doc_id {}, key long, held_out boolean, trains boolean, n_tokens long, part int, ids binary, words binary, counts binary"


def stored_texts(rows: DataFrame, path: str) -> DataFrame:
    """Of rows doc_id, text, held_out, trains, key: a row each with its number of words; pieces of texts' ids under part 0 and up; their words,
    counted, as blocks; and counts of the ids of training texts, under -1 and down."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        counts = np.zeros(bpe.size, np.int64)
        doc_type = None

        def wide(n: int, **given) -> pa.RecordBatch:
            kinds = {"doc_id": doc_type, "key": pa.int64(), "held_out": pa.bool_(), "trains": pa.bool_(), "n_tokens": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if k not in given else given[k] if isinstance(given[k], pa.Array) else pa.array(given[k], t) for k, t in kinds.items()], names=list(kinds))

        for batch in batches:
            doc_type = batch.column(0).type
            for part in cut(batch):
                ids, offsets = bpe.encode(part.column(1).to_pylist())
                trains, key = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy()
                counts += np.bincount(ids[np.repeat(trains, np.diff(offsets))], minlength=bpe.size)
                counts[bpe.size - 1] += int(trains.sum())  # each text's end
                edges = np.unique(np.linspace(0, part.num_rows, PIECES + 1).astype(np.int64)).tolist()
                for a, b in zip(edges, edges[1:], strict=False):
                    own = ids[offsets[a] : offsets[b]]
                    yield wide(1, part=[zlib.crc32(own.tobytes()) >> 1], ids=[_store(own, offsets[a : b + 1], key[a:b], trains[a:b], bpe.size)])
                # a long text's words are counted by pieces; what is known of them adds up
                pieces, first = at_blanks(part.column(1).to_pylist())
                of = np.repeat(np.arange(part.num_rows), np.diff(first))
                n_words = np.zeros(part.num_rows, np.int64)
                for a, b in by_size(pieces):
                    n, word, which, count = _word_counts(*flat(pa.array(pieces[a:b], pa.string())))
                    n_words += np.bincount(of[a:b], n, part.num_rows).astype(np.int64)
                    if len(word):
                        yield wide(1, words=[write_block([word, count], (2 * key + trains)[of[a:b]][which], np.zeros(len(word), np.int64))])
                yield wide(part.num_rows, doc_id=part.column(0), key=part.column(4), held_out=part.column(2), trains=part.column(3), n_tokens=n_words + 1)
        if doc_type is not None:
            for k, chunk in enumerate(np.array_split(counts, CHUNKS)):
                yield wide(1, part=[-1 - k], counts=[chunk.tobytes()])

    return rows.select("doc_id", "text", "held_out", "trains", "key").mapInArrow(tidy(run), _STORED.format(kind))


def _summed(rows: DataFrame) -> np.ndarray:
    """Counts of all ids; each chunk is summed in one task and CHUNKS rows are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.int64)
                total[part] = total[part] + x if part in total else x
        for part, x in total.items():
            yield _row(part, x.tobytes())

    got = rows.repartitionById(CHUNKS, F.col("part") + CHUNKS).mapInArrow(tidy(run), _SMALL).collect()
    return np.concatenate([np.frombuffer(r.block, np.int64) for r in sorted(got, key=lambda r: -r.part)]) if got else np.zeros(0, np.int64)


def _pack(trainer: attention.Trainer) -> Iterator[tuple[int, bytes]]:
    """The trainer's sums: of each row that it has seen, the number, the weight and the row times the weight, dealt over chunks; and the dense parameters."""
    p = trainer.p
    tables = [(p["embed"], trainer.seen["embed"]), (np.concatenate([p["node"], p["bias"][:, None]], 1), trainer.seen["node"])]
    for k, (table, seen) in enumerate(tables):
        there = np.flatnonzero(seen)
        for i in range(CHUNKS):  # numbers rise with rarity, so ranges of them would be uneven
            own = there[there % CHUNKS == i]
            yield k * CHUNKS + i, _rows(own, seen[own], table[own] * seen[own][:, None])
    dense = np.concatenate([p[k].ravel() for k in _DENSE]) * trainer.tokens
    yield 2 * CHUNKS, _rows(np.zeros(1, np.int64), np.full(1, trainer.tokens), dense[None])


def _rows(own: np.ndarray, weight: np.ndarray, table: np.ndarray) -> bytes:
    return b"".join([np.array([len(own)], "<u4").tobytes(), own.astype("<u4").tobytes(), weight.astype("<f4").tobytes(), table.astype("<f4").tobytes()])


def _added(blocks: Iterator[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, weights and sums of blocks' rows; numbers of a chunk are dealt, so `size` places hold them."""
    total = None
    for data in blocks:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        own = np.frombuffer(data, "<u4", n, 4).astype(np.int64)
        body = np.frombuffer(data, "<f4", offset=4 + 8 * n).reshape(n, -1) if n else None
        if body is None:
            continue
        if total is None:
            total = np.zeros((size, body.shape[1] + 1))
            first = own[0] % CHUNKS
        total[own // CHUNKS, :-1] += body
        total[own // CHUNKS, -1] += np.frombuffer(data, "<f4", n, 4 + 4 * n)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1))
    seen = np.flatnonzero(total[:, -1])
    return seen * CHUNKS + first, total[seen, -1], total[seen, :-1]


def _averaged(rows: DataFrame, params: dict[str, np.ndarray], trainers: int) -> dict[str, np.ndarray]:
    """Each row's mean over the trainers that saw it, weighted by how often; a row that none saw stays.

    rows: part, block of _pack(), where part is the chunk and, above it, the trainer. Sums of FAN trainers at a time are added, then of FAN such sums, and so on.
    """
    each, fan = 2 * CHUNKS + 1, FAN
    size = -(-len(params["embed"]) // CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk, trainer = part % each, part // each
                parts.setdefault(trainer // fan * each + chunk, []).append(data)
        for part, blocks in parts.items():
            yield _row(part, _rows(*_added(iter(blocks), size)))

    groups = trainers
    while True:
        groups = -(-groups // fan)
        rows = rows.repartitionById(groups * each, (F.floor(F.col("part") / (each * fan)) * each + F.col("part") % each).cast("int")).mapInArrow(tidy(run), _SMALL)
        if groups == 1:
            break
    got = {r.part: _added(iter([r.block]), size) for r in rows.collect()}  # bounded by the vocabulary
    if not got:
        return params
    tables = {"embed": params["embed"].copy(), "node": np.concatenate([params["node"], params["bias"][:, None]], 1)}
    for part, (own, weight, total) in got.items():
        if part < 2 * CHUNKS and len(own):
            tables["embed" if part < CHUNKS else "node"][own] = total / weight[:, None]
    out = {"embed": tables["embed"], "node": tables["node"][:, :-1].copy(), "bias": tables["node"][:, -1].copy()}
    _, weight, total = got[2 * CHUNKS]
    dense, at = total[0] / weight[0], 0
    for k in _DENSE:
        out[k] = dense[at : at + params[k].size].reshape(params[k].shape).astype(np.float32)
        at += params[k].size
    return out


def train(stored: DataFrame, path: str, dim: int = DIM) -> tuple[dict[str, np.ndarray], attention.Tree]:
    """Parameters and output tree from the training texts among stored_texts(); without any, the untrained model."""
    spark = stored.sparkSession
    counts = _summed(stored.where("counts IS NOT NULL").select("part", F.col("counts").alias("block")))
    size = load(path).size
    tree = attention.Tree.build(counts if len(counts) else np.zeros(size, np.int64))
    params = attention.new_params(size, tree.bias, dim)
    shared_tree = spark.sparkContext.broadcast(tree)  # bounded by the vocabulary
    trainers = max(1, int(counts.sum()) // TRAINER_TOKENS)
    first = max(1, trainers // 4)
    shares = [("part % 4 = 0", first), ("part % 4 > 0", max(1, trainers - first))]
    for condition, n in shares:
        start = spark.sparkContext.broadcast(params)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            trainer = attention.Trainer(start.value, shared_tree.value, 0.2)
            parts = sorted((p, x) for batch in batches for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            order = np.random.default_rng(0)
            for _, data in parts:
                ids, offsets, _, trains = _restore(data, size)
                length = np.diff(offsets)
                ids, offsets = ids[np.repeat(trains, length)], np.append(0, np.cumsum(length[trains]))
                inputs, target, _, _ = attention.blocks_of(ids, offsets, size - 1)
                at = order.permutation(len(inputs))
                trainer.learn(inputs[at], target[at])
            if parts:
                number = TaskContext.get().partitionId()
                for part, data in _pack(trainer):
                    yield _row(number * (2 * CHUNKS + 1) + part, data)

        share = stored.where(f"ids IS NOT NULL AND {condition}").select("part", F.col("ids").alias("block")).repartitionById(n, (F.floor(F.col("part") / 4) % n).cast("int"))
        params = _averaged(share.mapInArrow(tidy(learn), _SMALL), params, n)
        del share
        release(spark)
    return params, tree


def _word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and hash, text and count of its distinct ones."""
    data = _LOWER[data]
    starts, ends, word_at = word_spans(data, offsets)
    n_words = np.diff(word_at)
    if not len(starts):
        return n_words, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = span_hash(prefix_hash(BYTE_WORD[data]), starts, ends)
    of = np.repeat(np.arange(len(n_words)), n_words)
    order, fresh = groups(keys ^ text_salt(len(n_words))[of])
    own = order[fresh]
    return n_words, keys[own], of[own], np.diff(np.append(fresh, len(order)))


def _word_totals(stored: DataFrame, parts: int) -> DataFrame:
    """part, block: each fragment's distinct words with their counts in training texts, those without any left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            nonlocal word, total
            both, n = np.concatenate([word, *(x for x, _ in held)]), np.concatenate([total, *(x for _, x in held)])
            held.clear()
            word, at = np.unique(both, return_inverse=True)
            total = np.bincount(at, n, len(word)).astype(np.int64)

        for batch in batches:
            for data in batch.column(0).to_pylist():
                (own, n), key, _ = read_block(data, 2)
                used = (key & 1).astype(bool)
                held.append((own[used], n[used].astype(np.int64)))
                if sum(len(x) for x, _ in held) > BLOCK_ROWS:
                    merge()
        merge()
        yield from send(_part(word, parts), [word, total.astype(np.uint64)], np.zeros(len(word), np.int64), np.zeros(len(word), np.int64))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, 2)
        if got is None:
            return
        (word, n), _, _ = got
        word, at = np.unique(word, return_inverse=True)
        total = np.bincount(at, n.astype(np.int64), len(word)).astype(np.uint64)
        yield from send(_part(word, parts), [word, total], np.zeros(len(word), np.int64), np.zeros(len(word), np.int64))

    return stored.where("words IS NOT NULL").select("words").mapInArrow(tidy(count), BLOCKS).repartitionById(parts, "part").mapInArrow(tidy(join), BLOCKS)


def _part(word: np.ndarray, parts: int) -> np.ndarray:
    return ((word >> np.uint64(16)) * np.uint64(parts) >> np.uint64(48)).astype(np.int32)


def _frequent(totals: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur `least` times or more, in order of their hashes, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, 2)
        if got is not None:
            (word, n), _, _ = got
            many = n >= least
            yield _row(0, np.stack([word[many], n[many]]).tobytes())

    rows = [np.frombuffer(r.block, np.uint64).reshape(2, -1) for r in totals.mapInArrow(tidy(run), _SMALL).collect()]
    both = np.concatenate(rows, 1) if rows else np.zeros((2, 0), np.uint64)
    order = np.argsort(both[0])
    return both[0][order], both[1][order].astype(np.int64)


def _sums(totals: DataFrame) -> tuple[int, int]:
    """All training words and the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, 2)
        if got is not None:
            yield pa.RecordBatch.from_pydict({"words": [int(got[0][1].sum())], "distinct": [len(got[1])]})

    row = totals.mapInArrow(tidy(run), "words long, distinct long").agg(F.sum("words").alias("words"), F.sum("distinct").alias("distinct")).first()
    return row.words or 0, row.distinct or 0


def _known_and_base(word: np.ndarray, count: np.ndarray, key: np.ndarray, words: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order, how many of their words are known, and their words' part of the base score; a word that isn't listed has no count."""
    at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
    seen = np.where(words[at] == word, totals[at], 0) if len(words) else np.zeros(len(word), np.int64)
    own, base = _ordered_sums(key, count * np.log10(seen + 1.0))
    _, which = np.unique(key, return_inverse=True)
    return own, np.bincount(which, np.where(seen > 0, count, 0), len(own)).astype(np.uint64), base


def lm_scores(df: DataFrame, path: str, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32(id as text) modulo `folds` is `held` are held out; the model and the counts
    learn from the others. A row with a null id is neither held out nor learned from. A null
    or empty text has one token, the end. score is the model's log10 probability of the
    text's subword ids and the end. Rows may repeat; each is counted and scored. Other columns are
    not read. An empty table gives no rows; without training rows the model is uniform over
    its tree and no token is known.
    """
    spark = small_batches(df.sparkSession)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    remainder = fold(id_col, folds)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("trains"), F.monotonically_increasing_id().alias("key"))
    scratch = Scratch(spark)
    stored = scratch.table(stored_texts(rows, path))
    params, tree = train(stored, path)
    model = spark.sparkContext.broadcast((params, tree))  # bounded by the vocabulary

    totals = scratch.table(_word_totals(stored, parts))
    n_words, n_distinct = _sums(totals)
    ends = stored.where("trains").count()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    frequent = spark.sparkContext.broadcast(_frequent(totals, max(2, int(n_words * FREQUENT))))  # at most 1 / FREQUENT words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = load(path).size
        p, tree = model.value
        sums = _Sums(parts)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, offsets, key, _ = _restore(data, size)
                inputs, target, of, _ = attention.blocks_of(ids, offsets, size - 1)
                ll = np.bincount(of, attention.log_prob(p, tree, inputs, target, 128), len(key)) / np.log(10)
                yield from sums.add(key, np.zeros(len(key), np.uint64), np.zeros(len(key)), ll)
        yield from sums.rest()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = frequent.value
        rare: list[tuple[np.ndarray, ...]] = []
        sums = _Sums(parts)

        def above(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                yield block.set_column(0, "part", pa.array(block.column(0).to_numpy() + parts, pa.int32()))

        def flush() -> Iterator[pa.RecordBatch]:
            word, count, key = (np.concatenate([x[k] for x in rare]) for k in range(3))
            rare.clear()
            yield from send(_part(word, parts), [word, count], key, np.zeros(len(key), np.int64))

        for batch in batches:
            for data in batch.column(0).to_pylist():
                (word, count), key, _ = read_block(data, 2)
                key = key >> 1
                at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
                common = words[at] == word if len(words) else np.zeros(len(word), bool)
                own, known, base = _known_and_base(word[common], count[common].astype(np.int64), key[common], words, counts)
                yield from above(sums.add(own, known, base, np.zeros(len(own))))
                rare.append((word[~common], count[~common], key[~common]))
                if sum(len(x[0]) for x in rare) > BLOCK_ROWS:
                    yield from flush()
        if rare:
            yield from flush()
        yield from above(sums.rest())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare words meet their fragment's counts; a fragment's words are few, since frequent ones stayed."""
        asked, known_words = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind:
                    (word, n), _, _ = read_block(data, 2)
                    known_words = word, n.astype(np.int64)
                else:
                    asked.append(read_block(data, 2))
        if not asked:
            return
        word, count, key = np.concatenate([g[0][0] for g in asked]), np.concatenate([g[0][1] for g in asked]).astype(np.int64), np.concatenate([g[1] for g in asked])
        asked.clear()
        own, known, base = _known_and_base(word, count, key, *known_words)
        yield from _results(own, known, base, np.zeros(len(own)), parts)

    kind = dict(df.dtypes)[id_col]
    out = f"doc_id {kind}, held_out boolean, trains boolean, n_tokens long, n_known long, base double, score double"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, packed = [], []
        for batch in batches:
            packed += [read_block(x, 3) for x in batch.column("block").drop_null().to_pylist()]
            plain.append(batch.filter(batch.column("block").is_null()))
        key = np.concatenate([g[1] for g in packed]) if packed else np.zeros(0, np.int64)
        known, base, ll = (np.concatenate([g[0][k] for g in packed]) if packed else np.zeros(0, np.uint64) for k in range(3))
        sums = [_ordered_sums(key, x) for x in (known.astype(np.int64), _floats(base), _floats(ll))]
        own = sums[0][0]
        for batch in plain:
            at = np.searchsorted(own, batch.column("key").to_numpy())  # every text has a score, so every key is there
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "trains", "n_tokens")), *(pa.array(x[at]) for _, x in sums)], names=["doc_id", "held_out", "trains", "n_tokens", "n_known", "base", "score"])

    spreaded = checkpoint(stored.where("words IS NOT NULL").select("words").mapInArrow(tidy(spread), BLOCKS))
    rare = spreaded.where(F.col("part") < parts).select("part", F.lit(0).alias("kind"), "block").unionByName(totals.select("part", F.lit(1).alias("kind"), "block"))
    from_rare = rare.repartitionById(parts, "part").mapInArrow(tidy(meet), BLOCKS)
    scored = stored.where("ids IS NOT NULL").select("ids").mapInArrow(tidy(score), BLOCKS)
    sums = from_rare.unionByName(scored).unionByName(spreaded.where(F.col("part") >= parts).select((F.col("part") - parts).alias("part"), "block"))

    @F.pandas_udf("int")
    def home_of(key: pd.Series) -> pd.Series:
        return pd.Series(home(key.to_numpy(), parts))

    texts = stored.where("n_tokens IS NOT NULL").select(home_of("key").alias("part"), "doc_id", "key", "held_out", "trains", "n_tokens")
    both = texts.unionByName(sums, allowMissingColumns=True)
    release(spark)
    table = checkpoint(both.repartitionById(parts, "part").mapInArrow(tidy(gather), out))
    scratch.drop()
    lower = float(np.log10(total + distinct + 1))
    return table.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(lower)).alias("base_score"),
        "score",
    )


def _results(key: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sums of texts on their way home."""
    yield from send(home(key, parts), [known, base.view(np.uint64), score.view(np.uint64)], key, np.zeros(len(key), np.int64))


class _Sums:
    """Sums of texts, sent home once there are those of TEXTS."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, *sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(sums)
        self.size += len(sums[0])
        if self.size >= TEXTS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from _results(*(np.concatenate(x) for x in zip(*self.held, strict=True)), self.parts)
        self.held, self.size = [], 0


def _floats(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.float64)


def _ordered_sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and their sums, the same in whatever order the rows came."""
    if not len(key):
        return key, value
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(value, first)
