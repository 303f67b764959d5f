"""A store of document chunks in bucket folders, so that an upload rewrites what it touches and no more.

Rows of one source and user lie in one bucket, the folder `bucket=<n>`. A
replacement reads the buckets of the files it replaces (partition pruning),
writes them beside the store, and puts them in their places by dynamic
partition overwrite; other folders are not opened. The store keeps its number
of buckets in the folder's name, so all writers agree on it.

Two writers of one bucket at once are not kept apart: the caller runs one
upload at a time for a user, as a web service does that holds a row lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.shared import cut, discard


def bucket_of(source: Column, user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source, user_id), F.lit(buckets)).cast("int")


def write(documents: DataFrame, path: str, buckets: int) -> None:
    """documents as a new store at path, a bucket's rows together."""
    at = documents.withColumn("bucket", bucket_of(F.col("metadata.source"), F.col("user_id"), buckets))
    at.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/buckets={buckets}")


def _place(spark: SparkSession, path: str) -> tuple[str, int]:
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    found = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm(path, "buckets=*")) or []
    if len(found) != 1:
        raise FileNotFoundError(f"no store of buckets at {path}")
    place = found[0].getPath()
    return place.toString(), int(place.getName().partition("=")[2])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store, with `bucket`."""
    return spark.read.option("basePath", _place(spark, path)[0]).parquet(_place(spark, path)[0])


def of(spark: SparkSession, path: str, source: str, user_id: str) -> DataFrame:
    """A user's rows of one source; one folder is read."""
    bucket = spark.range(1).select(bucket_of(F.lit(source), F.lit(user_id), _place(spark, path)[1])).head()[0]
    return read(spark, path).where((F.col("bucket") == bucket) & (F.col("metadata.source") == source) & (F.col("user_id") == user_id))


def replace(spark: SparkSession, path: str, names: DataFrame, chunks: DataFrame) -> list[int]:
    """Put chunks in place of all rows of the files names (source, user_id); the numbers of the rewritten buckets.

    Chunks belong to the files of names (others raise ValueError: their former
    rows would stay beside them). A bucket that is left without rows is emptied.
    A null source or user is no file.
    """
    place, buckets = _place(spark, path)
    files = cut(names.select("source", "user_id").where(F.col("source").isNotNull() & F.col("user_id").isNotNull()).distinct().withColumn("bucket", bucket_of(F.col("source"), F.col("user_id"), buckets)), "files")
    mine = chunks.withColumn("source", F.col("metadata.source"))
    if not mine.join(files, ["source", "user_id"], "left_anti").isEmpty():
        raise ValueError("chunks of other files than those to be replaced")
    touched = sorted(r["bucket"] for r in files.select("bucket").distinct().collect())  # as many as buckets at most
    if not touched:
        return []
    old = read(spark, path).where(F.col("bucket").isin(touched)).withColumn("source", F.col("metadata.source"))
    left = old.join(files, ["source", "user_id"], "left_anti")
    new = mine.withColumn("bucket", bucket_of(F.col("source"), F.col("user_id"), buckets))
    rows = cut(left.unionByName(new, allowMissingColumns=True).drop("source"), "bucket-rows")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(place)
    full = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    for bucket in set(touched) - full:  # dynamic overwrite leaves partitions without rows as they were
        jvm(place).getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm(place, f"bucket={bucket}"), True)
    discard(rows, files)
    return touched
