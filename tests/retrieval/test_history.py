"""Histories of repositories, versions with vectors, and stores of indexes."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.code import code_fingerprint
from lexmill.operators import versions
from lexmill.operators.versions import InvalidHistory
from lexmill.plans import history, search
from lexmill.sources import io
from lexmill.streaming.lineage import append_stream


class Repo:
    def __init__(self, folder):
        self.path = folder
        folder.mkdir()
        self("init", "-q")
        self("config", "user.name", "Test")
        self("config", "user.email", "test@example.invalid")

    def __call__(self, *args):
        return subprocess.run(["git", "-C", str(self.path), *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(self, files):
        for name, text in files.items():
            (self.path / name).unlink() if text is None else (self.path / name).write_text(text)
        self("add", "-A")
        self("commit", "-q", "-m", "change")
        return self("rev-parse", "HEAD")


@F.udf(T.ArrayType(T.FloatType()))
def one_hot(code):
    return [1.0, 0.0] if code else [0.0, 1.0]


def test_import_edit_delete_and_replay(spark, tmp_path):
    repo, store = Repo(tmp_path / "repo"), str(tmp_path / "store")
    shas = [repo.commit({"f.py": x, "g.py": "y = 1"}) for x in ("def f(): return 1", "def f(): return 2", None)]
    bring = lambda **k: history.import_history(spark, str(repo.path), ["f.py", "g.py"], store, encode=one_hot, dims=2, **k)
    assert bring() == 4 and bring() == 0
    log = spark.read.parquet(f"{store}/versions").orderBy("logical_id", "append_seq").collect()
    assert [(r.logical_id, r.version, r.metadata["operation"], r.change_type, r.vec) for r in log] == [
        ("f.py", shas[0], "added", "initial", [1.0, 0.0]), ("f.py", shas[1], "modified", "substantial_update", [1.0, 0.0]), ("f.py", shas[2], "deleted", "deleted", [0.0, 0.0]), ("g.py", shas[0], "added", "initial", [1.0, 0.0]),
    ]
    assert log[0].title == "f.py" and log[0].language == "python" and log[0].metadata["commit"] == shas[0]
    snapshots, rows = spark.read.parquet(f"{store}/snapshots"), spark.read.parquet(f"{store}/versions")
    scope = lambda *a: sorted((r.logical_id, r.version) for r in versions.in_scope(rows, a[0], "append_seq", snapshots, *a[1:]).collect())
    assert scope("commit", shas[1]) == [("f.py", shas[1]), ("g.py", shas[0])] and scope("latest") == scope("commit", shas[2]) == [("g.py", shas[0])]
    with pytest.raises(InvalidHistory):
        scope("commit", "missing")
    more = repo.commit({"g.py": None})
    assert bring() == 1
    rows, snapshots = spark.read.parquet(f"{store}/versions"), spark.read.parquet(f"{store}/snapshots")
    assert versions.in_scope(rows, "latest", "append_seq", snapshots).count() == 0
    assert tuple(versions.storage(rows).first()) == (2, 5, 40, 8) and rows.where(F.col("version") == more).first().change_type == "deleted"
    with pytest.raises(InvalidHistory, match="files"):
        history.import_history(spark, str(repo.path), ["f.py"], store)


def test_windows_and_divergence(spark, tmp_path):
    repo = Repo(tmp_path / "repo")
    shas = [repo.commit({"f.py": f"x = {i}"}) for i in range(3)]
    store = str(tmp_path / "bounded")
    bring = lambda most: history.import_history(spark, str(repo.path), ["f.py"], store, max_commits=most)
    assert bring(2) == 2
    assert spark.read.parquet(f"{store}/versions").orderBy("append_seq").first().metadata["operation"] == "baseline"
    with pytest.raises(InvalidHistory, match="older or divergent"):
        bring(3)
    for n in range(2):
        repo.commit({"notes.txt": str(n)})
        assert bring(1 + n) == 0
        latest = versions.in_scope(spark.read.parquet(f"{store}/versions"), "latest", "append_seq", spark.read.parquet(f"{store}/snapshots")).collect()
        assert [r.version for r in latest] == [shas[2]]
    repo.commit({"f.py": "x = 9"})
    assert bring(1) == 1
    assert [r.metadata["operation"] for r in spark.read.parquet(f"{store}/versions").orderBy("append_seq").collect()] == ["baseline", "modified", "modified"]
    repo("checkout", "-q", shas[0])
    repo("checkout", "-q", "-b", "other")
    repo.commit({"f.py": "x = 100"})
    with pytest.raises(InvalidHistory, match="older or divergent"):
        bring(1)


def test_code_versions_compare_by_their_trees(spark, tmp_path):
    schema = "logical_id string, version string, code string, arrival long, deleted boolean"
    one = "def f(a):\n    if a:\n        b()\n        c()\n"
    rows = [("p", "1", one, 0, False), ("p", "2", one.replace("a:", "a:  # why"), 1, False), ("p", "3", one.replace("        c()", "    c()"), 2, False), ("p", "4", "", 3, True), ("p", "5", one, 4, False)]
    df = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], "logical_id string, version string, code string, append_seq long")
    kinds = lambda **k: [r.change_type for r in versions.append(empty, df, **k).orderBy("append_seq").collect()]
    assert kinds(fingerprint=code_fingerprint) == ["initial", "unchanged", "near_duplicate_update", "deleted", "substantial_update"]
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", title string, metadata map<string,string>").json(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp"), fingerprint=code_fingerprint).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log")).orderBy("append_seq").collect()
    assert [r.change_type for r in got] == kinds(fingerprint=code_fingerprint) and "metadata" in got[0].asDict()


def test_only_changed_versions_are_encoded(spark):
    count = spark.sparkContext.accumulator(0)

    @F.udf(T.ArrayType(T.FloatType()))
    def counted(code):
        count.add(1)
        return [float(len(code)), 1.0]

    schema = "logical_id string, version string, code string, arrival long, deleted boolean"
    stored = spark.createDataFrame([("p", "0", "a b", 0, [7.0, 7.0])], "logical_id string, version string, code string, append_seq long, vec array<float>")
    new = spark.createDataFrame([("p", "1", "a  b", 0, False), ("p", "2", "z", 1, False), ("p", "3", "z ", 2, False), ("p", "4", "", 3, True), ("p", "5", "", 4, False), ("q", "1", "hello", 5, False)], schema)
    got = versions.append(stored, new, encode=counted, dims=2).orderBy("logical_id", "append_seq").collect()
    assert [(r.version, r.change_type, r.vec) for r in got] == [("1", "unchanged", [7.0, 7.0]), ("2", "substantial_update", [1.0, 1.0]), ("3", "unchanged", [1.0, 1.0]), ("4", "deleted", [0.0, 0.0]), ("5", "unchanged", [0.0, 0.0]), ("1", "initial", [5.0, 1.0])]
    assert count.value == 2


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([("b", "import os\nfor i in x:\n  for j in x: f()", 0), ("a", "def g(): g()", 1), ("c", "def broken(:", 2)], "id string, code string, pos long")
    folder = str(tmp_path / "index")
    assert io.build_index(docs, folder) == {"documents": 3, "parsed": 2, "unparsed": 1, "recursive": 1, "nested": 1}
    manifest = io.parse_object((tmp_path / "index" / "manifest.json").read_text())
    assert manifest["documents"] == 3 and {k.split("/")[0] for k in manifest["files"]} == {"corpus", "records", "symbols"} and len(manifest["files"]) >= 3
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        io.build_index(docs, folder)
    engine = search.open_engine(spark, folder)
    assert engine is search.open_engine(spark, folder) and engine.vectors is None
    assert [r["id"] for r in engine.search(search.Request("which files import os?"))["results"]] == ["b"]
    assert [r["id"] for r in engine.search(search.Request("find recursive functions"))["results"]] == ["a"]
    with pytest.raises(search.Unavailable):
        search.open_engine(spark, str(tmp_path / "nothing"))

    table = str(tmp_path / "t")
    for n in (3, 5):
        io.replace_table(spark.range(n), table)
        assert spark.read.parquet(table).count() == n
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t.")] == []
    io.write_json_document(spark.createDataFrame([("é", 1)], "a string, b int"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"a": "é", "b": 1}] and "é" in (tmp_path / "r.json").read_text()
    with pytest.raises(FileExistsError):
        io.write_json_document(spark.range(1), str(tmp_path / "r.json"))
    for bad in ('{"a": 1, "a": 2}', '{"x": [{"b": 1, "b": 1}]}'):
        with pytest.raises(ValueError, match="twice"):
            io.parse_object(bad)


def test_vectors_at_their_places(spark, tmp_path):
    data = np.arange(40, dtype="<f4").reshape(10, 4)
    (tmp_path / "v.f32").write_bytes(data.tobytes())
    got = io.read_raw_vectors(spark, str(tmp_path / "v.f32"), 4)
    assert {r.pos: list(r.vec) for r in got.collect()} == {i: row.tolist() for i, row in enumerate(data)}
    ids = spark.createDataFrame([(i, f"d{i}") for i in range(10)], "pos long, id string")
    assert {r.id: r.vec[0] for r in io.align_vectors(got, ids).collect()} == {f"d{i}": 4.0 * i for i in range(10)}
    with pytest.raises(Exception, match="differ at place 9"):
        io.align_vectors(got, ids.where("pos < 9")).collect()
    with pytest.raises(ValueError, match="within a row"):
        io.read_raw_vectors(spark, str(tmp_path / "v.f32"), 3)
