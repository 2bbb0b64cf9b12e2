"""The pipeline on a small fixture, against plain Python stages."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from lexmill.llm import langid, quality
from lexmill.llm.common import flat
from tests.llm.test_jaccard import plain_components
from tests.llm.test_substrings import plain


def plain_cut(rows: list[tuple]) -> dict:
    """What is left of each text."""
    seen: dict[bytes, int] = {}
    for key, text in rows:
        data = text.encode()
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            seen[w] = min(seen.get(w, key), key)
    out = {}
    for key, text in rows:
        data = text.encode()
        lost = bytearray(len(data))
        for i in range(len(data) - 49):
            if seen[data[i : i + 50]] < key:
                lost[i : i + 50] = b"\1" * 50
        out[key] = bytes(c for c, x in zip(data, lost, strict=True) if not x).decode("utf-8", "ignore")
    return out


def test_stages_against_plain_python(spark, tmp_path):
    import tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**7, None, "en", "s", 0), (10**7 + 1, "", None, None, None), (10**7 + 2, "1 2 3 " * 9 + " ".join(map(str, range(40))), "en", "s", 9)], docs.schema)
    docs = docs.unionByName(odd)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    tables = [frame]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], str(tmp_path)).cache()
        tables.append(out)
    for a in tables[1:-1]:
        assert a.columns == docs.columns and a.schema.simpleString() == docs.schema.simpleString()

    failed, kept = quality.verdict(quality.measure(*flat(pa.array(list(rows.values())))))
    assert (failed & kept).sum() == 0
    want = {k for k, x in zip(rows, kept, strict=True) if x}
    assert {r.doc_id for r in tables[1].collect()} == want and len(want) > 100
    second = {r.doc_id: r.text for r in tables[2].collect()}
    score = {r.doc_id: r.score for r in langid.language_id(tables[1]).collect()}
    assert set(second) == {k for k in want if score[k] >= langid.LEAST} and 10**7 + 2 not in second
    component = plain_components(sorted(second.items()))
    third = {r.doc_id: r.text for r in tables[3].collect()}
    assert third == {k: t for k, t in second.items() if component[k][1] == k}
    fourth = {r.doc_id: (r.text, r.n_chars) for r in tables[4].collect()}
    assert fourth == {k: (t, len(t)) for k, t in plain_cut(sorted(third.items())).items()}
    assert any(len(fourth[k][0]) < len(third[k]) for k in third)

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = tables[5].collect()
    length = {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, (t, _) in fourth.items()}
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
    assert {k: sum(n for *_, n in v) for k, v in by_doc.items()} == length
    assert all(sorted(v) == [(i, 4096 * i, min(4096, length[k] - 4096 * i)) for i in range(len(v))] for k, v in by_doc.items())
    ends: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1.02 * -(-sum(length.values()) // 4096) + 1

    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in ran) == sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in pieces)


def test_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_plain_agrees_with_itself():
    rows = [(1, "x" * 60), (2, "y" + "x" * 55)]
    assert [len(plain_cut(rows)[k].encode()) for k, _ in rows] == [n - r for _, n, r, *_ in plain(rows)]
