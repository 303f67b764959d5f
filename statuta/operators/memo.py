"""Vectors by the hash of their text, kept as soon as they are made, so that no text is sent to a model twice.

A memo is a folder for each model: `calls` (a file a call, put there by the
task that made the call) and `kept` (tables that compact() makes of those).
embed() asks for each different text once, and only for those without a vector.
A task that is retried finds the files of its former calls by the digest of
the texts in them; a run that is repeated finds the vectors by key. Of a task
that dies, only the call it was in is made again.

Files are written beside and renamed, and readers see whole files only; two
attempts at one call leave one file. The path is one of a file system that
Arrow and Spark both read (local, HDFS, S3, GCS).

Defined cases: a null text counts as an empty one; repeated texts share a
vector; a call that fails gives its rows the error, keeps nothing, and is made
again in the next run; an empty table makes no call; only the named columns are
read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.options import DEFAULTS
from statuta.shared import cut, discard
from statuta.sources.providers import Embedder

SCHEMA = "content_key string, embedding array<float>"
FILE = pa.schema([("content_key", pa.string()), ("embedding", pa.list_(pa.float32()))])


def kept_call(root: str, keys: list[str], texts: list[str], embedder: Embedder) -> str | None:
    """Put the vectors of one call's texts in its file, unless it is there; the embedder's error, if any. Errors of the file system are the task's."""
    fs, folder = arrow_fs.FileSystem.from_uri(root)
    name = hashlib.sha256("\n".join(keys).encode()).hexdigest()
    path = f"{folder}/{name}.parquet"
    if fs.get_file_info(path).type == arrow_fs.FileType.File:
        return None
    try:
        vectors = embedder(texts)
    except Exception as e:  # noqa: BLE001  other calls go on
        return f"{type(e).__name__}: {e}"[:500]
    if len(vectors) != len(texts):
        return f"{len(vectors)} vectors for {len(texts)} texts"
    made = f"{folder}/_{name}-{uuid.uuid4().hex}"  # Spark does not read names that begin so
    with fs.open_output_stream(made) as out:
        pq.write_table(pa.table([pa.array(keys, pa.string()), pa.array(vectors, FILE.field(1).type)], FILE), out)
    fs.move(made, path)
    return None


class Memo:
    """The vectors of one model under one path."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        root = path if "://" in path else f"file://{path}"
        self.spark, self.root = spark, f"{root.rstrip('/')}/model={quote(model, '').replace('%', '=')}"

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _files(self) -> list[str]:
        """Whole files of calls."""
        fs, path = self._folder("calls")
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p.toString() for p in names if not p.getName().startswith("_"))

    def known(self) -> DataFrame:
        """(content_key, embedding) of all texts that have been embedded, each once."""
        out = self.spark.createDataFrame([], SCHEMA)
        if self._files():
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(f"{self.root}/calls"))
        fs, path = self._folder("kept")
        if fs.exists(path):
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(path.toString()))
        return out.dropDuplicates(["content_key"])

    def embed(self, rows: DataFrame, text: str, key: str, embedder: Embedder, batch: int = DEFAULTS.embed_batch) -> DataFrame:
        """(key, embedding, error), as providers.embed gives, with a call for new texts only."""
        fs, calls = self._folder("calls")
        fs.mkdirs(calls)
        root = f"{self.root}/calls"
        hashed = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("content_key", T.content_hash(F.col("_text")))
        wanted = hashed.groupBy("content_key").agg(F.min("_text").alias("text"))
        # Written, so that a retried task reads the same rows in the same order and makes the same calls.
        todo = cut(wanted.join(self.known(), "content_key", "left_anti"), "todo")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first in range(0, whole.num_rows, batch):
                    part = whole.slice(first, batch)
                    error = kept_call(root, part.column(0).to_pylist(), part.column(1).to_pylist(), embedder)
                    if error is not None:
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([error] * part.num_rows, pa.string())], ["content_key", "error"])

        failed = cut(todo.mapInArrow(run, "content_key string, error string"), "failed")
        discard(todo)
        found = self.known().withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
        # A frequent text is many rows of one key on the left only, which adaptive execution splits.
        return hashed.drop("_text").join(found, "content_key", "left").select(key, "embedding", "error")

    def compact(self) -> int:
        """Move the calls made so far from their files into `kept`; how many files. No embed() may run meanwhile."""
        files = self._files()
        if files:
            self.spark.read.schema(SCHEMA).parquet(f"{self.root}/calls").write.mode("append").parquet(f"{self.root}/kept")
            fs, calls = self._folder("calls")
            fs.delete(calls, True)  # if this is lost, texts are in both, and known() gives them once
        return len(files)
