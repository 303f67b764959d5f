"""Streaming ingestion of articles, and the folders it writes.

What an article's stream has brought so far is keyed state: the hashes of its
texts and the number of its newest version. So a micro-batch costs what its own
rows cost, however old the store is, and the store is never read. Out come
changes: an article's new text is inserted with the next version number and
supersedes the one before.

The store is a folder of appended Parquet batches, `batch=<n>`; a batch that is
retried overwrites its own folder, and a folder whose write never ended is not
read, so each change is stored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from statuta.operators.store import ARTICLE_KEY, insert_status
from statuta.shared import shared_path

ARTICLE = ("law_name", "article_no")
STATEFUL = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ArticleProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "content_hash string", "version int")
        self.newest = handle.getValueState("newest", "version int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("position", kind="stable")
        version = self.newest.get()[0] if self.newest.exists() else 0
        statuses, versions = [], []
        for content_hash in batch["content_hash"]:
            if content_hash is None or any(k is None for k in key):
                statuses.append("failed")
                versions.append(None)
            elif self.seen.containsKey((content_hash,)):
                statuses.append("skipped")
                versions.append(self.seen.getValue((content_hash,))[0])
            else:
                version += 1
                self.seen.updateValue((content_hash,), (version,))
                statuses.append("inserted")
                versions.append(version)
        self.newest.update((version,))
        yield batch.assign(status=statuses, version=pd.array(versions, "Int32"))

    def close(self) -> None:
        pass


def changes(articles: DataFrame) -> DataFrame:
    """Streamed articles (position, law_name, article_no, content_hash, ...) with `status` and `version`.

    inserted: a text its article has not had, with the article's next version;
    skipped: one it has had, with the version that was; failed: a part of the
    key is null. Rows of an article are taken by position within a micro-batch.
    """
    schema = StructType([*articles.schema.fields, StructField("status", StringType()), StructField("version", IntegerType())])
    return articles.groupBy(*ARTICLE).transformWithStateInPandas(ArticleProcessor(), schema, "append", "none")


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes the inserted rows of a batch below path, once however often it is retried."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col("status") == "inserted").drop("status").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were written to their end."""
    done = _finished(spark, path)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def current(rows: DataFrame) -> DataFrame:
    """Stored rows with is_current: true for the highest version of each article. No window: only keys and versions are grouped."""
    newest = rows.groupBy(*ARTICLE).agg(F.max("version").alias("version")).withColumn("newest", F.lit(True))
    return rows.join(newest, [*ARTICLE, "version"], "left").withColumn("is_current", F.coalesce("newest", F.lit(False))).drop("newest")


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Folders of batches that have Spark's mark of success."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "batch=*/_SUCCESS")) or []
    return [m.getPath().getParent().toString() for m in marks]


def append_new(path: str, position: str = "position") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch without state: each batch reads the keys of the batches before it. For streams that begin on a store."""

    def write(batch: DataFrame, number: int) -> None:
        keys = earlier(batch, path, number)
        new = insert_status(batch, keys, order=position).where(F.col("status") == "inserted").drop("status")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def earlier(batch: DataFrame, path: str, number: int) -> DataFrame:
    """Keys of the articles that batches of smaller numbers stored."""
    spark, schema = batch.sparkSession, ", ".join(f"{k} string" for k in ARTICLE_KEY)
    done = [p for p in _finished(spark, path) if int(p.rpartition("=")[2]) < number]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def in_rounds(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a streaming query makes of tables that arrive one after the other, each in a run of its own on one checkpoint."""
    spark = parts[0].sparkSession
    root, before = shared_path(spark, name), spark.conf.get(STATEFUL)
    made = stream(spark.readStream.schema(parts[0].schema).parquet(f"{root}/in/*"))
    spark.conf.set(STATEFUL, ROCKS)
    try:
        for i, part in enumerate(parts):
            part.write.parquet(f"{root}/in/{i}")
            run = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(STATEFUL, before)
    return spark.read.schema(made.schema).parquet(f"{root}/out")
