"""Readers, writers and manifests."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.code import metadata

DOCUMENT = "id string, title string, language string, code string, retrieval_code string"
VERSION = "logical_id string, version string, title string, language string, metadata map<string,string>, code string, fingerprint string, previous_similarity double, change_type string"


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One object a line; blank lines are skipped, absent fields are null, and a broken line is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """id, vec of a Parquet table, checked by valid_vectors()."""
    return valid_vectors(spark.read.parquet(path), dims)


def read_matrix_files(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, vec: the rows of .npy files, one file a task and a batch of rows at a time."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = np.load(io.BytesIO(data), allow_pickle=False).astype(np.float32)
                for at in range(0, len(matrix), 4096):
                    rows = matrix[at : at + 4096]
                    vec = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(rows), "pos": np.arange(at, at + len(rows)), "vec": vec})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, vec array<float>")


def read_raw_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """pos, vec of contiguous float32 in one file of any size, split by rows; an error if its size is no whole number of rows."""
    import numpy as np

    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getLen()
    if size % (4 * dims):
        raise ValueError("the vector file ends within a row")
    # DataFrame readers hold a binary file in one row; this format cuts it into records, numbered from the start of the file
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(4 * dims)})
    return rows.map(lambda kv: (int(kv[0]), np.frombuffer(bytes(kv[1]), "<f4").tolist())).toDF("pos long, vec array<float>")


def valid_vectors(vectors: DataFrame, dims: int, vec: str = "vec") -> DataFrame:
    """The rows, or an error at the first vector of another length or with a value that isn't finite."""
    odd = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bad = F.col(vec).isNull() | (F.size(vec) != dims) | odd
    return vectors.withColumn(vec, F.when(bad, F.raise_error(F.lit(f"a vector isn't {dims} finite numbers"))).otherwise(F.col(vec)))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of files as they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """An error if the table is there already; readers see all of it or nothing."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, non-ASCII characters as they are, nulls left out."""
    df.write.mode("errorifexists").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows and their vectors in one commit, so neither can be there without the other. One writer at a time."""
    df.write.mode("append").parquet(path)


def export_rankings(ranked: DataFrame, k: int = 100) -> DataFrame:
    """qid, docs: ids in rank order, and the same with scores."""
    rows = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"))
    return rows.select("qid", F.transform("r", lambda x: x["doc_id"]).alias("docs"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["doc_id"], x["score"]))).alias("scores"))


def write_json_document(df: DataFrame, path: str, indent: int = 1) -> None:
    """One readable document, a list of all rows, for reports of a few rows; they go through the driver, and the file comes into place in one step."""
    text = json.dumps([json.loads(x) for x in df.toJSON().toLocalIterator()], indent=indent, ensure_ascii=False)
    _put(df.sparkSession, path, text)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a text beside its place and move it there; an error if something is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, target):
        raise OSError(f"{path} can't be written")


def replace_table(df: DataFrame, path: str) -> None:
    """A new snapshot in place of the old one: written whole beside it, then swapped by renames, so readers see the old or the new."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.mode("errorifexists").parquet(new)
    fs = place(path).getFileSystem(conf)
    if fs.exists(place(path)) and not fs.rename(place(path), place(old)):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(place(new), place(path)):
        fs.rename(place(old), place(path))
        raise OSError(f"{path} can't be replaced")
    fs.delete(place(old), True)


def parse_object(text: str) -> dict:
    """A JSON object; a key that stands twice in one, at any depth, is an error."""

    def once(pairs: list[tuple]) -> dict:
        names = [k for k, _ in pairs]
        if len(set(names)) < len(names):
            raise ValueError(f"a key stands twice: {next(k for k in names if names.count(k) > 1)}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)


def align_vectors(vectors: DataFrame, ids: DataFrame, pos: str = "pos") -> DataFrame:
    """id, vec by equal places; an error at the first place that only one side has, so lengths can't differ unseen."""
    both = vectors.select(pos, "vec", F.lit(True).alias("_v")).join(ids.select(pos, "id", F.lit(True).alias("_i")), pos, "full")
    alone = F.raise_error(F.concat(F.lit("vectors and ids differ at place "), F.col(pos).cast("string"))).cast(ids.schema["id"].dataType)
    return both.select(F.when(F.col("_v").isNull() | F.col("_i").isNull(), alone).otherwise(F.col("id")).alias("id"), "vec")


def manifest(spark: SparkSession, path: str, **counts: int) -> str:
    """JSON of counts and of each file's hash by its place below the path; files of writers' own bookkeeping are left out."""
    root = PurePosixPath(path.split(":", 1)[-1] if "://" not in path else path.split("://", 1)[1].partition("/")[2])
    rows = {}
    for r in file_hashes(spark, path).toLocalIterator():  # a row a file
        own = r.path.split(":", 1)[-1]
        below = own[own.index(str(root).rstrip("/")) + len(str(root).rstrip("/")) :].lstrip("/")
        if not any(x.startswith(("_", ".")) for x in below.split("/")):
            rows[below] = r.sha256
    return json.dumps({**counts, "files": dict(sorted(rows.items()))}, sort_keys=True)


def build_index(documents: DataFrame, path: str) -> dict[str, int]:
    """Corpus in its order, structural records and symbols as three tables, and a manifest with what index_counts() counts; an error if the folder has them."""
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c != "pos"]
    order = F.col("pos") if "pos" in documents.columns else F.monotonically_increasing_id()
    write_new(documents.select(*kept, order.alias("pos")), f"{path}/corpus")
    records = spark.read.parquet(f"{path}/corpus").select("id", "pos", metadata(F.coalesce("code", F.lit(""))).alias("m")).select("id", "pos", "m.*")
    write_new(records, f"{path}/records")
    from lexmill.operators.code_reports import index_counts
    from lexmill.operators.symbolic import symbols

    stored = spark.read.parquet(f"{path}/records")
    write_new(symbols(stored), f"{path}/symbols")
    counts = index_counts(stored).first().asDict()
    _put(spark, f"{path}/manifest.json", manifest(spark, path, **counts))
    return counts
