"""Jaccard join of word-shingle sets by vertical partitioning.

The global order of shingles, by their hash, is cut into fragments. Each fragment counts,
for every set, how many of its shingles another set has too; the counts are summed per
set, and a set that has too few shared shingles can't link. What is left is small: there,
rare shingles come first, sets that share a shingle of their prefixes are candidates, and
each fragment counts the overlaps of the candidate pairs within itself; these partial
overlaps are summed per pair.

Documents with equal sets are one class from the start, so copies are never paired.
Sets that a group's most central member already links are not paired with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCKS, home, receive, send
from .blocks import read_block as read_pairs
from .common import BYTE_WORD, LONG, LOWER, Scratch, at_blanks, checkpoint, cut, flat, free_name, groups, materialize, mix, prefix_hash, small_batches, span_hash, stored_bytes, text_salt, tidy, word_spans
from .graph import components

#: Bits of a shingle's identity; two different shingles of two linked sets collide once in 2^48 / n^2.
BITS = 48
_ODD = 0x94D049BB133111EB
_LOWER = np.frombuffer(LOWER, np.uint8)
#: Shingles that a task gathers before it writes a block for each fragment.
BLOCK_ROWS = 1_500_000
#: Bytes of kept sets in each fragment that counts the overlaps of candidate pairs.
FRAGMENT_BYTES = 8 << 20
#: Shingles of candidate pairs that a fragment looks up at once.
LOOKUPS = 2_000_000
#: Words of 64 bits in a set's bitmap, a power of two.
WORDS = 8
#: Rounds of stars before the remaining pairs, and members at a star's centre after the first round.
STARS, CENTERS = 2, 16


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and the text of each; a shorter text is one shingle."""
    data = _LOWER[data]
    starts, ends, word_at = word_spans(data, offsets)
    n_words = np.diff(word_at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = prefix_hash(span_hash(prefix_hash(BYTE_WORD[data]), starts, ends), _ODD)
    of = np.repeat(np.arange(len(n_words)), n_words)
    at = np.arange(len(starts))
    first = word_at[:-1][of] == at
    at = at[(word_at[1:][of] - at >= width) | first & (n_words[of] < width)]
    of = of[at]
    length = np.minimum(n_words[of], width)
    keys = span_hash(words, at, at + length, _ODD) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order, fresh = groups(keys ^ text_salt(len(n_words))[of])
    own = np.sort(order[fresh])
    return keys[own], of[own]


def long_shingles(text: str, width: int, most: int = LONG) -> np.ndarray:
    """Distinct shingle hashes of one long text, piece by piece, each with the words that its last windows reach into."""
    white, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    reach, whole = re.compile(f"(?:{white}+{word}){{{width - 1}}}"), re.compile(f"{white}*{word}(?:{white}+{word}){{{width - 1}}}")
    keys, at = np.zeros(0, np.uint64), 0
    pieces, _ = at_blanks([text], most)
    for i, piece in enumerate(pieces):
        if i and not whole.match(text, at):
            break  # the windows that start here would be too short
        end = at + len(piece)
        more = reach.match(text, end)
        own, _ = shingles(*flat(pa.array([text[at : more.end() if more else len(text)]])), width)
        keys = np.unique(np.concatenate([keys, own]))
        at = end + 1
    return keys


def class_keys(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set, and a hash of it."""
    size = np.bincount(of, minlength=n)
    total = np.append(np.uint64(0), np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D))))
    edges = np.append(0, np.cumsum(size))
    return size, mix(total[edges[1:]] - total[edges[:-1]] + size.astype(np.uint64))


def write_block(shingle: np.ndarray, key: np.ndarray, extra: np.ndarray) -> bytes:
    """A block of (shingle, set, small number): sets listed once, shingles as sorted differences."""
    order = np.argsort(shingle, kind="stable")
    shingle, extra = shingle[order], extra[order]
    sets, which = np.unique(key[order], return_inverse=True)
    steps = np.diff(shingle, prepend=np.uint64(0))
    base, steps[0] = int(steps[0]), 0
    wide = int(len(sets) > 1 << 16) | 2 * int(steps.max() >= 1 << 32) | 4 * int(extra.any())
    head = np.array([wide, len(shingle), len(sets), base], np.uint64)
    parts = [head, sets, steps.astype(np.uint64 if wide & 2 else np.uint32), which.astype(np.uint32 if wide & 1 else np.uint16)]
    return b"".join([x.tobytes() for x in parts] + [extra.astype(np.uint8).tobytes()] * (wide >> 2))


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide, n, n_sets, base = (int(x) for x in np.frombuffer(data, np.uint64, 4))
    at = 32
    sets = np.frombuffer(data, np.uint64, n_sets, at)
    at += 8 * n_sets
    steps = np.frombuffer(data, np.uint64 if wide & 2 else np.uint32, n, at)
    at += steps.nbytes
    which = np.frombuffer(data, np.uint32 if wide & 1 else np.uint16, n, at)
    at += which.nbytes
    extra = np.frombuffer(data, np.uint8, n, at) if wide & 4 else np.zeros(n, np.uint8)
    return np.cumsum(steps.astype(np.uint64)) + np.uint64(base), sets[which], extra


#: A row is a document with its set's size and hash, a set's size (weight 0), a block on its way, or a kept set.
_ROWS = "part int, doc_id {}, n long, key long, block binary, shingles array<long>, weight double"


def _fragment(shingle: np.ndarray, parts: int) -> np.ndarray:
    return (shingle * np.uint64(parts) >> np.uint64(BITS)).astype(np.int32) if parts < 1 << 15 else (shingle >> np.uint64(16)).astype(np.int64) * parts >> (BITS - 16)


def _rows(doc_type: pa.DataType, part, doc_id=None, n=None, key=None, block=None, shingles=None, weight=None) -> pa.RecordBatch:
    size = len(part)
    fields = (("part", part, pa.int32()), ("doc_id", doc_id, doc_type), ("n", n, pa.int64()), ("key", key, pa.int64()), ("block", block, pa.binary()), ("shingles", shingles, pa.list_(pa.int64())), ("weight", weight, pa.float64()))
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for _, x, t in fields], names=[k for k, _, _ in fields])


def _blocks(doc_type: pa.DataType, part: np.ndarray, shingle: np.ndarray, key: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    shingle, key, extra = shingle[order], key[order], extra[order]
    parts, first = np.unique(part[order], return_index=True)
    for p, a, b in zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield _rows(doc_type, [p], block=[write_block(shingle[a:b], key[a:b], extra[a:b])])


def _flush(doc_type: pa.DataType, held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    short, key = (np.concatenate([x[k] for x in held]) for k in range(2))
    held.clear()
    yield from _blocks(doc_type, _fragment(short, parts), short, key, np.zeros(len(key), np.uint8))


def _split(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[tuple]]:
    """Rows about sets, and the decoded blocks."""
    rows, blocks = [], []
    for batch in batches:
        is_block = batch.column("block").is_valid()
        blocks += [read_block(x) for x in batch.column("block").drop_null().to_pylist()]
        rows.append(batch.filter(is_block.to_numpy(zero_copy_only=False) == False))  # noqa: E712
    return rows, blocks


def _kept_sets(sets: DataFrame, doc_kind: str, parts: int, homes: int) -> DataFrame:
    """Of rows with sets and blocks of their shingles, spread by fragment: the sets that may link.

    Fragments count each shingle's sets; those in two or more go to their sets, where the
    counts of all fragments meet and sets with under 3/4 shared shingles drop out.
    """

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, blocks = _split(batches)
        for batch in rows:
            is_size = batch.column("weight").is_valid()
            yield batch.filter(pc.invert(is_size))  # a document's row goes anywhere
            sizes = batch.filter(is_size)
            _, first = np.unique(sizes.column("key").to_numpy(), return_index=True)
            key = sizes.column("key").to_numpy()[first].view(np.uint64)
            yield _rows(batch.schema.field("doc_id").type, (key % np.uint64(homes)).astype(np.int32), n=sizes.column("n").take(first), key=key.view(np.int64), weight=np.zeros(len(key)))
        if not blocks:
            return
        doc_type = rows[0].schema.field("doc_id").type
        shingle = np.concatenate([x[0] for x in blocks])
        key = np.concatenate([x[1] for x in blocks])
        blocks.clear()
        order, fresh = groups(shingle)
        size = np.diff(np.append(fresh, len(order)))
        order = order[np.repeat(size > 1, size)]
        shingle, key = shingle[order], key[order]  # equal shingles stand together
        run = np.cumsum(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
        again = np.lexsort((key, run))
        shingle, key, run = shingle[again], key[again], run[again]
        own = np.ones(len(key), bool)
        own[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        shingle, key, run = shingle[own], key[own], run[own]
        count = np.bincount(run, minlength=1)[run] if len(run) else run
        many = count > 1
        shingle, key, count = shingle[many], key[many], count[many]
        rarity = np.minimum(np.floor(8 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)
        yield from _blocks(doc_type, (key % np.uint64(homes)).astype(np.int32), shingle, key, rarity)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, blocks = _split(batches)
        sizes: dict[int, int] = {}
        for batch in rows:
            is_size = batch.column("weight").is_valid()
            own = batch.filter(is_size)
            sizes.update(zip(own.column("key").to_pylist(), own.column("n").to_pylist(), strict=True))
            yield batch.filter(pc.invert(is_size))
        if not blocks:
            return
        doc_type = rows[0].schema.field("doc_id").type
        shingle, key, rarity = (np.concatenate([x[k] for x in blocks]) for k in range(3))
        order = np.lexsort((shingle, rarity, key))
        shingle, key, rarity = shingle[order], key[order].view(np.int64), rarity[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        m = np.diff(np.append(first, len(key)))
        n = np.array([sizes[k] for k in key[first].tolist()], np.int64)
        enough = 100 * m >= 75 * n
        take = np.repeat(enough, m)
        offsets = np.append(0, np.cumsum(m[enough])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shingle[take].view(np.int64)))
        weight = np.add.reduceat(rarity.astype(float), first)[enough] / m[enough]
        yield _rows(doc_type, np.zeros(int(enough.sum()), np.int32), n=n[enough], key=key[first][enough], shingles=lists, weight=weight)

    schema = _ROWS.format(doc_kind)
    return sets.repartitionById(parts, "part").mapInArrow(tidy(share), schema).repartitionById(homes, "part").mapInArrow(tidy(gather), schema)


def _with_bits(kept: DataFrame) -> DataFrame:
    """Adds b0, b1, ...: a bitmap of the shingles' lowest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            shingle = lists.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            words = np.zeros((batch.num_rows, WORDS), np.uint64)
            np.bitwise_or.at(words, (of, (shingle >> np.uint64(6) & np.uint64(WORDS - 1)).astype(np.int64)), np.uint64(1) << (shingle & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(words[:, k].view(np.int64)) for k in range(WORDS))], names=[*batch.schema.names, *_BITS])

    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in _BITS)]))


def _least(n: Column) -> Column:
    """Fewest common shingles of a set with anything it links with."""
    return F.ceil(F.lit(75) * n / F.lit(100)).cast("long")


def _measure(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Links (a, b) among distinct candidate pairs (a, b, need): fragments count their overlaps, which are summed per pair.

    `need` is the overlap of a link. A pair travels with its first set, to the fragments in which that set has shingles.
    """
    parts = max(2, -(-stored_bytes(kept) // FRAGMENT_BYTES))
    homes = -(-parts // 4)
    partners = pairs.groupBy(F.col("a").alias("key")).agg(F.collect_list(F.struct("b", "need")).alias("partners"))
    ends = partners.unionByName(pairs.select(F.col("b").alias("key")), allowMissingColumns=True).groupBy("key").agg(F.first("partners", ignorenulls=True).alias("partners"))
    sets = kept.select("key", "shingles").join(ends.hint("shuffle_hash"), "key")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists, partners = batch.column("key").to_numpy(), batch.column("shingles"), batch.column("partners")
            shingle = lists.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(key)), lists.value_lengths().to_numpy())
            part = _fragment(shingle, parts).astype(np.int32)
            yield from send(2 * part, [shingle], key[of], np.zeros(len(of), np.int64))
            # each pair once for every fragment that its first set is in
            at = np.unique(of * parts + part)
            inside, fragment = at // parts, at % parts
            n = np.nan_to_num(pc.list_value_length(partners).to_numpy(zero_copy_only=False)).astype(np.int64)
            first = np.cumsum(n) - n
            size = n[inside]
            row = np.repeat(first[inside] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            other = partners.flatten()
            b, need = (pc.struct_field(other, k).to_numpy()[row] for k in ("b", "need"))
            yield from send((2 * np.repeat(fragment, size) + 1).astype(np.int32), [b.view(np.uint64), need], np.repeat(key[inside], size), np.zeros(len(row), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, wanted = [], []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part % 2:
                    (b, need), a, _ = read_pairs(data, 2)
                    wanted.append((a, b.view(np.int64), need.astype(np.int64)))
                else:
                    (shingle,), key, _ = read_pairs(data, 1)
                    members.append((shingle, key))
        if not members or not wanted:
            return
        shingle, key = (np.concatenate([x[k] for x in members]) for k in range(2))
        a, b, need = (np.concatenate([x[k] for x in wanted]) for k in range(3))
        members.clear()
        wanted.clear()
        kinds, shingle = np.unique(shingle, return_inverse=True)
        sets, key = np.unique(key, return_inverse=True)
        code = np.unique(key * len(kinds) + shingle)
        edge = np.searchsorted(code, np.arange(len(sets) + 1) * len(kinds))
        x, y = np.searchsorted(sets, a), np.minimum(np.searchsorted(sets, b), len(sets) - 1)
        there = sets[y] == b
        a, b, need, x, y = a[there], b[there], need[there], x[there], y[there]
        size = (edge[x + 1] - edge[x]).astype(np.int64)
        ends = np.cumsum(size)
        partial = np.zeros(len(a), np.int64)
        at = 0
        while at < len(a):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + LOOKUPS, "right")))
            own = np.repeat(np.arange(at, stop), size[at:stop])
            place = np.arange(len(own)) + base - (ends - size)[own] + edge[x[own]]
            sought = code[place] + (y[own] - x[own]) * len(kinds)
            found = np.minimum(np.searchsorted(code, sought), len(code) - 1)
            partial[at:stop] = np.bincount(own - at, code[found] == sought, stop - at)
            at = stop
        some = partial > 0
        yield from send(home(a[some], homes), [b[some].view(np.uint64), partial[some], need[some]], a[some], np.zeros(int(some.sum()), np.int64))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = receive(batches, 3)
        if got is None:
            return
        (b, partial, need), a, _ = got
        order = np.lexsort((b, a))
        a, b, partial, need = a[order], b[order], partial[order].astype(np.int64), need[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        linked = first[np.add.reduceat(partial, first) >= need[first]]
        yield pa.RecordBatch.from_pydict({"a": a[linked], "b": b[linked].view(np.int64)})

    counted = sets.mapInArrow(tidy(spread), BLOCKS).repartitionById(parts, (F.col("part") / 2).cast("int")).mapInArrow(tidy(count), BLOCKS)
    return counted.repartitionById(homes, "part").mapInArrow(tidy(total), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_BITS = [f"b{k}" for k in range(WORDS)]
#: Shingles of one set that the bitmap of the other lacks; neither has them in common.
_LACKS = " + ".join("bit_count({0}.b%d & ~{1}.b%d)" % (k, k) for k in range(WORDS))
_ALIKE = f"7 * least(x.m - ({_LACKS.format('x', 'y')}), y.m - ({_LACKS.format('y', 'x')})) >= 3 * (x.n + y.n)"
#: Of two sets that share a prefix shingle: their overlap is at most what either set shares at all ...
_FITS = "7 * least(x.m, y.m) >= 3 * (x.n + y.n)"
#: ... and, from their first common shingle on, at most what is left of either set; later ones leave less.
_ROOM = "7 * least(x.m - x.at, y.m - y.at) >= 3 * (x.n + y.n)"


def _candidates(df: DataFrame, id_col: str, text_col: str, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with the size and hash of their sets, sets that may link, and prefix shingles that sets have in common, each with its most central set."""
    kind = dict(df.dtypes)[id_col]
    spark = small_batches(df.sparkSession)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = -(-parts // 4)  # far fewer shingles go to their sets than come from the texts

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, sent = 0, set()
        for batch in batches:
            for part in cut(batch):
                if part.num_rows == 1 and len(text := part.column(1)[0].as_py() or "") > LONG:
                    keys = long_shingles(text, width)
                    of = np.zeros(len(keys), np.int64)
                else:
                    keys, of = shingles(*flat(part.column(1)), width)
                size, own = class_keys(keys, of, part.num_rows)
                doc_type = part.column(0).type
                yield _rows(doc_type, (mix(own + np.arange(part.num_rows, dtype=np.uint64)) % np.uint64(parts)).astype(np.int32), doc_id=part.column(0), n=size, key=own.view(np.int64))
                # of the copies that a task has, one sends the set
                new = np.zeros(part.num_rows, bool)
                for i, x in enumerate(own.tolist()):
                    if size[i] and x not in sent:
                        sent.add(x)
                        new[i] = True
                yield _rows(doc_type, (own[new] % np.uint64(parts)).astype(np.int32), n=size[new], key=own[new].view(np.int64), weight=np.zeros(int(new.sum())))
                mine = new[of]
                held.append((keys[mine] >> np.uint64(64 - BITS), own[of[mine]]))
                rows += int(mine.sum())
                if rows > BLOCK_ROWS:
                    yield from _flush(doc_type, held, parts)
                    rows = 0
        if held:
            yield from _flush(doc_type, held, parts)

    def respread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists = batch.column("key"), batch.column("shingles")
            shingle = lists.flatten().to_numpy().view(np.uint64)
            keys = key.to_numpy().view(np.uint64)
            doc_type = batch.column("doc_id").type
            yield _rows(doc_type, (keys % np.uint64(parts)).astype(np.int32), n=batch.column("n"), key=key, weight=np.zeros(len(key)))
            own = np.repeat(keys, lists.value_lengths().to_numpy())
            yield from _blocks(doc_type, _fragment(shingle, parts), shingle, own, np.zeros(len(own), np.uint8))

    schema = _ROWS.format(kind)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = scratch.table(_kept_sets(rows.mapInArrow(tidy(spread), schema), kind, parts, homes))
    docs = materialize(first.where("shingles IS NULL").select("doc_id", "n", "key"))
    # once more among those that are left: shared shingles of sets that dropped out don't count
    second = _kept_sets(first.where("shingles IS NOT NULL").mapInArrow(tidy(respread), schema), kind, parts, homes)
    kept = scratch.table(_with_bits(second.where("shingles IS NOT NULL").select("key", F.col("n").cast("int").alias("n"), "shingles", F.col("weight").cast("float").alias("weight"))))

    length = (F.size("shingles") - _least(F.col("n")) + 1).cast("int")
    prefix = kept.select("key", "n", F.size("shingles").alias("m"), "weight", F.posexplode(F.slice("shingles", 1, length)).alias("at", "s"))
    central = prefix.groupBy("s").agg(F.max(F.struct("weight", "key", "n", "m")).alias("y"), F.count("*").alias("sets")).where("sets > 1").select("s", "y")
    shared = scratch.table(prefix.join(central.hint("shuffle_hash"), "s"))
    return docs, kept, shared


def _pair(x: str, y: str) -> list[Column]:
    """a, b and need, the overlap that makes them a link: from 100 common >= 75 (n + n' - common)."""
    need = F.ceil(F.lit(3) * (F.col(f"{x}.n") + F.col(f"{y}.n")) / F.lit(7)).cast("int").alias("need")
    return [F.col(f"{x}.key").alias("a"), F.col(f"{y}.key").alias("b"), need]


def _all_pairs(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs of sets x of one table and y of the other that share a prefix shingle and can link; either goes first, by a hash, so none leads all of its pairs."""
    both = (F.col("s") == F.col("s2")) & (F.col("x.key") < F.col("y.key")) & F.expr(_FITS) & F.expr(_ROOM)
    met = left.join(right, both if condition is None else both & condition)
    ahead = F.xxhash64("x.key", "y.key") % 2 == 0
    x, y = F.when(ahead, F.col("x")).otherwise(F.col("y")), F.when(ahead, F.col("y")).otherwise(F.col("x"))
    return met.select(x.alias("x"), y.alias("y")).select(*_pair("x", "y")).distinct()


def _undecided(shared: DataFrame, label: DataFrame) -> DataFrame:
    """s, x and x's component, of prefix shingles whose sets are in two components or more."""
    named = shared.join(label.select(F.col("node"), "label").hint("shuffle_hash"), F.col("x.key") == F.col("node"), "left").select("s", "x", F.coalesce("label", "x.key").alias("label"))
    mixed = named.groupBy("s").agg(F.min("label").alias("lowest"), F.max("label").alias("highest")).where("lowest < highest").select("s")
    return named.join(mixed.hint("shuffle_hash"), "s")


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row: near-duplicate components at a Jaccard similarity of 0.75.

    Words are runs without white space, A-Z in lower case. A text's set holds its distinct
    shingles of `width` words; with fewer words, its whole sequence as one. A null text
    or one without words has an empty set, links with nothing and is its own component.
    Rows with equal sets form a class, repeated rows included; class_id is a set's hash, null
    for an empty one. component_id is the smallest id reachable by links. Null ids
    are never the smallest; a component of null ids only has a null id. Other columns are
    not read. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    docs, kept, shared = _candidates(df, id_col, text_col, width, scratch)
    one = F.struct("key", "n", "m", "at")
    # stars: each set with the most central one that it shares a prefix shingle with
    met = shared.select(one.alias("x"), "y").where(f"x.key <> y.key AND {_FITS}")
    star = met.groupBy("x.key").agg(F.max_by(F.struct("x", "y"), F.struct("y.weight", "y.key")).alias("p")).select(*_pair("p.x", "p.y"))
    links = checkpoint(_measure(star, kept))
    label = components(links)
    bits = kept.select(F.col("key").alias("own"), *_BITS)
    left = _undecided(shared.select("s", one.alias("x")), label).join(bits.hint("shuffle_hash"), F.col("x.key") == F.col("own"))
    shared = scratch.table(left.select("s", F.struct("x.*", *_BITS).alias("x"), "label"))
    # then with members of groups that are still in several components, one of each component for a set
    for turn in range(1, STARS):
        if shared.isEmpty():
            break
        seat = F.pmod(F.xxhash64("x.key", F.lit(turn)), F.lit(CENTERS))
        centers = shared.groupBy("s", seat.alias("seat")).agg(F.max(F.struct(F.xxhash64(F.lit(turn), "x.key").alias("order"), "x", "label")).alias("y")).select("s", F.col("y.x").alias("y"), F.col("y.label").alias("other"), F.col("y.order").alias("order"))
        met = shared.join(centers, "s").where(f"label <> other AND {_FITS} AND {_ROOM} AND {_ALIKE}")
        star = met.groupBy("x.key", "other").agg(F.max_by(F.struct("x", "y"), F.struct("order", "y.key")).alias("p")).select(*_pair("p.x", "p.y")).distinct()
        found = checkpoint(_measure(star, kept))
        links = links.unionByName(found)
        label = components(links)
        shared = scratch.table(_undecided(shared.select("s", "x"), label))

    # then all pairs that share a prefix shingle and that no star has brought together
    if not shared.isEmpty():
        right = shared.select(F.col("s").alias("s2"), F.col("label").alias("label2"), F.col("x").alias("y"))
        rest = _all_pairs(shared, right, (F.col("label") != F.col("label2")) & F.expr(_ALIKE))
        label = components(links.unionByName(_measure(rest, kept)))
    scratch.drop()

    own = docs.groupBy("key").agg(F.min("doc_id").alias("smallest")).where("key IS NOT NULL")
    joined = own.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    answer = joined.select("key", "label").join(joined.groupBy("label").agg(F.min("smallest").alias("component_id")), "label").select("key", "component_id")
    full = docs.where("n > 0").join(answer, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("class_id"))
    empty = docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return reduce(DataFrame.unionByName, [full, empty])


def _class_links(kept: DataFrame, shared: DataFrame) -> DataFrame:
    one = F.struct("key", "n", "m", "at", *_BITS)
    bits = kept.select("key", *_BITS).hint("shuffle_hash")
    left = shared.select("s", "key", "n", "m", "at").join(bits, "key").select("s", one.alias("x"))
    return _measure(_all_pairs(left, left.select(F.col("s").alias("s2"), F.col("x").alias("y")), F.expr(_ALIKE)), kept)


def class_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """a, b of every two classes (see jaccard_classes) with a similarity of 0.75 or more, a < b; none is left out inside a component."""
    scratch = Scratch(df.sparkSession)
    _, kept, shared = _candidates(df, id_col, text_col, width, scratch)
    links = checkpoint(_class_links(kept, shared))
    scratch.drop()
    return links


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links of every row; n_links counts the other classes that its class links with.

    Copies are in one class and not counted. An empty set has no class and no links.
    """
    scratch = Scratch(df.sparkSession)
    docs, kept, shared = _candidates(df, id_col, text_col, width, scratch)
    links = checkpoint(_class_links(kept, shared))
    scratch.drop()
    counts = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    own = docs.withColumn("key", F.when(F.col("n") > 0, F.col("key")))
    return own.join(counts, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of each near-duplicate component, that of the smallest id, with all its columns.

    Of rows that share that id, one stays. Rows with a null id all stay, since no id tells them apart.
    """
    name = free_name(df, "first")
    first = jaccard_classes(df, id_col, text_col, width).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    own = F.col(f"`{id_col}`")
    kept = df.join(first, own == F.col(name), "left_semi")
    if not df.groupBy(own.alias("id")).agg(F.count("*").alias("n")).where("id IS NOT NULL AND n > 1").isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        # a map has no hash of its own
        order = F.xxhash64(F.to_json(whole) if "map<" in df.schema.simpleString() else whole)
        one = kept.groupBy(own.alias("id")).agg(F.min_by(whole, order).alias("row"))
        kept = one.select(*(F.col("row")[c].alias(c) for c in df.columns))
    return kept.unionByName(df.where(own.isNull()))
