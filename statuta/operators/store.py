"""Tables as values: idempotent inserts, overwrites, deletes, revisions, back-fills and listings.

Spark tables of plain Parquet have no row updates, so each operator takes the
store as a DataFrame and returns the new one; the caller writes it elsewhere
and swaps, never over what is being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import strip
from statuta.shared import cut

ARTICLE_KEY = ("law_name", "article_no", "content_hash")


def insert_status(batch: DataFrame, store: DataFrame, key: tuple[str, ...] = ARTICLE_KEY, order: str = "position") -> DataFrame:
    """batch with `status`: inserted for the first row of a key that the store lacks, failed if a part of the key is null, else skipped."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    whole = F.exists(F.array(*(F.col(c).isNull() for c in key)), lambda x: x)
    known = store.select(*key).distinct().withColumn("known", F.lit(True))
    return batch.withColumn("nth", first).join(known, list(key), "left").withColumn("status", F.when(whole, "failed").when(F.col("known").isNull() & (F.col("nth") == 1), "inserted").otherwise("skipped")).drop("nth", "known")


def inserted(status: DataFrame, next_id: int, order: str = "position") -> DataFrame:
    """The inserted rows with ids from next_id on, in order; ids come from ranges and their counts, not from one sorted partition.

    The rows are written once with the number of their range: another plan over
    them, such as the counts alone, could be dealt into other partitions.
    """
    rows = status.where(F.col("status") == "inserted").drop("status").repartitionByRange(order)
    rows = cut(rows.withColumn("part", F.spark_partition_id()), "inserted")
    offsets, total = [], next_id
    for r in rows.groupBy("part").count().orderBy("part").collect():  # a row for each range
        offsets.append((r["part"], total))
        total += r["count"]
    base = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, base long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return rows.withColumn("within", within).join(base, "part").withColumn("id", F.col("base") + F.col("within") - 1).drop("part", "base", "within")


def supersede(articles: DataFrame) -> DataFrame:
    """articles with is_current true for the newest row (highest id) of each law and article only."""
    newest = F.max("id").over(Window.partitionBy("law_name", "article_no"))
    return articles.withColumn("is_current", F.col("id") == newest)


def backfill(store: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """store with vectors (id, embedding) where it has none, and `embed_status`: kept, embedded, failed or missing.

    Rows that got one have a new `updated_at`, if the store has that column.
    """
    new = vectors.select("id", F.col("embedding").alias("new"))
    fits = F.coalesce(F.size("new") == dimensions, F.lit(False)) & F.col("new").isNotNull()
    status = F.when(F.col("embedding").isNotNull(), "kept").when(F.col("new").isNull(), "missing").when(fits, "embedded").otherwise("failed")
    made = store.join(new, "id", "left").withColumn("embed_status", status).withColumn("embedding", F.coalesce("embedding", F.when(fits, F.col("new")))).drop("new")
    return touched(made, F.col("embed_status") == "embedded") if "updated_at" in store.columns else made


def touched(rows: DataFrame, changed: Column) -> DataFrame:
    """rows with the present time as updated_at where they were changed."""
    return rows.withColumn("updated_at", F.when(changed, F.current_timestamp()).otherwise(F.col("updated_at")))


def pending(store: DataFrame, tax_type: str | None = None) -> DataFrame:
    """Ids of current articles without a vector."""
    rows = store.where(F.col("embedding").isNull() & F.col("is_current"))
    return (rows if tax_type is None else rows.where(F.col("tax_type") == tax_type)).select("id")


def with_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_semi")


def _of(source: str, user_id: str) -> Column:
    return F.coalesce((F.col("metadata.source") == source) & (F.col("user_id") == user_id), F.lit(False))


def count_of(documents: DataFrame, source: str, user_id: str) -> DataFrame:
    return documents.where(_of(source, user_id)).agg(F.count("*").alias("n"))


def overwrite(documents: DataFrame, chunks: DataFrame, source: str, user_id: str) -> DataFrame:
    """documents with the user's rows of one source replaced."""
    return documents.where(~_of(source, user_id)).unionByName(chunks, allowMissingColumns=True)


def delete(documents: DataFrame, source: str, user_id: str) -> tuple[DataFrame, int]:
    """What is left and how many rows went; LookupError if none did."""
    n = count_of(documents, source, user_id).head()["n"]
    if not n:
        raise LookupError(source)
    return documents.where(~_of(source, user_id)), n


def listing(documents: DataFrame, *keys: str) -> DataFrame:
    """Chunks and first upload time by file, law and category."""
    grouped = documents.groupBy(*keys, F.col("metadata.source").alias("filename"), F.col("metadata.law_name").alias("law_name"), F.col("metadata.category").alias("category"))
    return grouped.agg(F.count("*").alias("chunk_count"), F.date_format(F.min("created_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"))


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, from 1 on in that order within the keys; nulls come first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def newest_first(listed: DataFrame, *keys: str) -> DataFrame:
    """A listing with `place`: files from the newest on, those of one time by name, within the keys."""
    order = Window.partitionBy(*keys).orderBy(F.desc("uploaded_at"), "filename", "law_name", "category")
    return listed.withColumn("place", F.row_number().over(order))


def coverage(articles: DataFrame) -> DataFrame:
    return articles.groupBy("law_name").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))


def guard_upload(files: DataFrame, max_bytes: int) -> DataFrame:
    """files (path, length, text) with `reject_code`: 400 no PDF, 413 too large, 422 nothing but white space; null if accepted."""
    code = F.when(~F.coalesce(F.lower("path").endswith(".pdf"), F.lit(False)), 400).when(F.col("length") > max_bytes, 413).when(F.coalesce(strip(F.col("text")), F.lit("")) == "", 422)
    return files.withColumn("reject_code", code)
