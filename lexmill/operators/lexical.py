"""BM25 for a stated query set, and the lexical score of lineages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions.text import code_tokens, plain_words
from lexmill.operators.dense import QUERY_BLOCK, Best, best_of, top_k

#: Documents whose counts of query tokens are one matrix.
DOCS = 512
#: Scores that are one matrix, and the most words times queries of a block, where names are scored.
PAIRS, MEMBERS = 500_000, 8_000_000


def _counted(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a batch; and of each document's distinct ones the document, the token and its count."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    words = column.flatten().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    code = np.repeat(np.arange(len(lengths)), lengths) * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, count = np.unique(code, return_counts=True)
    return words.dictionary, pair // max(len(words.dictionary), 1), pair % max(len(words.dictionary), 1), count


def _slices(column: pa.Array, most: int = 300_000) -> Iterator[pa.Array]:
    """Runs of rows with at most so many tokens together; a row with more stands alone."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, to - at)
        at = to


def _statistics(tokens: DataFrame) -> DataFrame:
    """token, n: documents of each token; under null the number of documents, and under the empty string that of all their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = length = 0
        for batch in batches:
            for part in _slices(batch.column(0)):
                words, _, word, _ = _counted(part)
                seen = np.bincount(word, minlength=len(words))
                df.update(dict(zip(words.to_pylist(), seen.tolist(), strict=True)))
            n += batch.num_rows
            length += len(batch.column(0).flatten())
            if len(df) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"token": pa.array(list(df), pa.string()), "n": pa.array(list(df.values()), pa.int64())})
                df.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array([*df, None, ""], pa.string()), "n": pa.array([*df.values(), n, length], pa.int64())})

    return tokens.select("tokens").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def bm25(queries: DataFrame, docs: DataFrame, depth: int = 100, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, query_id: str = "qid", doc_id: str = "doc_id", digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, doc_id, score, rank of each query's `depth` best documents among those that share a token; a repeated query token counts again.

    A token's idf is ln(N - df + .5) - ln(df + .5); negative ones become epsilon times the mean over
    all tokens. The queries are a stated set, in blocks. Two passes over the documents: the first counts each token's documents, combined within a task
    before they move; the second has the block's tokens with their idf broadcast, scores each document's few of them by a product and keeps a task's best,
    so neither tokens nor pairs are rows of an exchange. Scores are rounded to `digits`, ties go by id.
    """
    spark = docs.sparkSession
    tokens = docs.select(F.col(doc_id).alias("doc_id"), code_tokens(F.col("text")).alias("tokens"))
    asked = queries.select(F.col(query_id).alias("qid"), code_tokens(F.col("text")).alias("tokens"))
    kind = f"qid {dict(asked.dtypes)['qid']}, doc_id {dict(tokens.dtypes)['doc_id']}, score double"
    id_type = to_arrow_type(asked.schema["qid"].dataType)
    counts = _statistics(tokens).cache()
    try:
        n_docs = (counts.where("token IS NULL").first() or [None, 0])[1]
        size = (counts.where("token = ''").first() or [None, 0])[1]
        raw = F.log(F.lit(float(n_docs)) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
        idf = counts.where("token <> ''").select("token", raw.alias("raw"))
        mean = idf.agg(F.avg("raw").alias("mean")).first().mean or 0.0
        out = []
        rows: list = []
        for row in [*asked.toLocalIterator(), None]:
            if row is not None:
                rows.append(row)
            if not rows or (row is not None and len(rows) < block):
                continue
            words = sorted({t for r in rows for t in r.tokens})
            known = idf.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "token string")), "token") if words else None  # bounded by the block's texts
            value = {r.token: r.raw if r.raw >= 0 else epsilon * mean for r in known.collect()} if known is not None else {}
            place = {w: i for i, w in enumerate(sorted(value))}
            times = np.zeros((len(place), len(rows)))
            for k, r in enumerate(rows):
                for t in r.tokens:
                    if t in place:
                        times[place[t], k] += 1
            shared = spark.sparkContext.broadcast(([r.qid for r in rows], place, np.array([value[w] for w in place])[:, None] * times, times > 0, size / max(n_docs, 1)))
            rows = []
            out.append(tokens.mapInArrow(_scorer(shared, depth, k1, b, digits, id_type), kind))
    finally:
        counts.unpersist()
    if not out:
        return spark.createDataFrame([], f"{kind}, rank int")
    return top_k(reduce(DataFrame.unionByName, out), depth)


def holders(queries: DataFrame, docs: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, doc_id: the smallest id of a document that holds the whole text of a query (qid, text).

    The queries are a stated set: their texts are broadcast in blocks, and each block's are looked for in every document, all at once.
    """
    spark = docs.sparkSession
    kind = f"qid {dict(queries.dtypes)['qid']}, doc_id {dict(docs.dtypes)['doc_id']}"
    id_type = to_arrow_type(queries.schema["qid"].dataType)
    out, rows = [], []
    for row in [*queries.select("qid", "text").where("text IS NOT NULL").toLocalIterator(), None]:
        if row is not None:
            rows.append(row)
        if not rows or (row is not None and len(rows) < block):
            continue
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
        rows = []

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, places = [], []
                texts = batch.column(1).to_pylist()
                for key, passage in shared.value:
                    own = [i for i, t in enumerate(texts) if t is not None and passage in t]
                    ids += [key] * len(own)
                    places += own
                yield pa.RecordBatch.from_pydict({"qid": pa.array(ids, id_type), "doc_id": batch.column(0).take(pa.array(places, pa.int64()))})

        out.append(docs.select("doc_id", "text").mapInArrow(run, kind))
    if not out:
        return spark.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, out).groupBy("qid").agg(F.min("doc_id").alias("doc_id"))


def _scorer(shared, depth: int, k1: float, b: float, digits: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, weights, holds, average = shared.value
        best, kind = Best(depth, len(ids)), None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                words, doc, word, count = _counted(part.column(1))
                known = np.array([place.get(w, -1) for w in words.to_pylist()] or [-1])
                own = known[word] if len(word) else word
                doc, own, count = doc[own >= 0], own[own >= 0], count[own >= 0]
                length = part.column(1).value_lengths().fill_null(0).to_numpy()
                tf = count * (k1 + 1) / (count + k1 * (1 - b + b * length[doc] / max(average, 1e-300)))
                score = np.full((len(ids), part.num_rows), -np.inf)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                for d, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if x < y:  # a document holds few of the block's tokens
                        own_tokens = own[x:y]
                        total = np.round(tf[x:y] @ weights[own_tokens], digits) + 0.0
                        score[:, d] = np.where(holds[own_tokens].any(0), total, -np.inf)
                i, j = best_of(score, depth)
                best.add(i, part.column(0).take(pa.array(j)), score[i, j])
        if got := best.kept():
            yield pa.RecordBatch.from_pydict({"qid": pa.array(ids, id_type).take(pa.array(got["query"])), "doc_id": pa.array(got["doc"], kind), "score": got["score"]})

    return run


def lexical_evolution(queries: DataFrame, lineages: DataFrame, name: str = "logical_id", above: float = 0.0, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, logical_id, score over `above`, which is at least 0: 3 a query word in the name, 1 a query word in the titles, 5 if the query holds the whole name, be it within a word.

    lineages: logical_id, its name, titles (an array). The queries are a stated set, in blocks; lineages are scored where they lie, and only pairs over `above` are rows.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(plain_words(c), " ")), lambda w: w != "")
    asked = queries.select("qid", plain_words(F.col("text")).alias("plain"), words(F.col("text")).alias("words"))
    entry = lineages.select("logical_id", plain_words(F.col(name)).alias("name"), words(F.col(name)).alias("id_words"), words(F.concat_ws(" ", "titles")).alias("title_words"))
    spark = lineages.sparkSession
    kind = f"qid {dict(asked.dtypes)['qid']}, logical_id {dict(entry.dtypes)['logical_id']}, score double"
    id_type = to_arrow_type(asked.schema["qid"].dataType)
    out, rows, seen = [], [], set()

    def close() -> None:
        shared = spark.sparkContext.broadcast(([r.qid for r in rows], [r.plain for r in rows], [r.words for r in rows]))
        out.append(entry.mapInArrow(_evolution_scorer(shared, above, id_type), kind))
        rows.clear()
        seen.clear()

    for row in asked.toLocalIterator():
        if rows and (len(rows) == block or (len(rows) + 1) * len(seen.union(row.words)) > MEMBERS):
            close()
        rows.append(row)
        seen.update(row.words)
    if rows:
        close()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], kind)


def _evolution_scorer(shared, above: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, asked = shared.value
        keys, text = pa.array(ids, id_type), "\n".join(texts)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        place = {w: i for i, w in enumerate(sorted({w for ws in asked for w in ws}))}
        member = np.zeros((len(place), len(ids)), np.float32)  # whether a query has a word
        for k, ws in enumerate(asked):
            member[[place[w] for w in ws], k] = 1
        step = max(1, PAIRS // len(ids))
        holders: dict[str, np.ndarray] = {}

        def holding(name: str) -> np.ndarray:
            """The queries that hold a name."""
            if name not in holders:
                if len(holders) == 100_000:
                    holders.clear()
                found, at = [], text.find(name) if name else -1
                while at >= 0:
                    found.append(int(np.searchsorted(starts, at, "right")) - 1)
                    at = text.find(name, starts[found[-1] + 1])
                holders[name] = np.array(found, np.int64)
            return holders[name]

        def add(score: np.ndarray, column: pa.Array, weight: float) -> None:
            words = column.flatten().dictionary_encode()
            known = np.array([place.get(w, -1) for w in words.dictionary.to_pylist()] or [-1])
            code = known[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))[code >= 0]
            code = code[code >= 0]
            first = np.searchsorted(row, row)
            for nth in range(int((np.arange(len(row)) - first).max(initial=-1)) + 1):  # one word of each row at a time
                own = np.arange(len(row)) - first == nth
                score[row[own]] += weight * member[code[own]]

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                score = np.zeros((part.num_rows, len(ids)), np.float32)
                add(score, part.column(2), 3.0)
                add(score, part.column(3), 1.0)
                for k, name in enumerate(part.column(1).to_pylist()):
                    score[k, holding(name)] += 5.0
                i, j = np.nonzero(score > above)
                yield pa.RecordBatch.from_pydict({"qid": keys.take(pa.array(j)), "logical_id": part.column(0).take(pa.array(i)), "score": score[i, j].astype(np.float64)})

    return run
