"""Reading tables, shared folders and lineage cuts (from statuta.shared), and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.shared import cut, discard, shared_path, shared_root  # noqa: F401

#: A document is held out when crc32 of its id, as text, leaves no remainder.
FOLDS = 5
#: Bytes of a table's files up to which their rows are dealt to all cores.
SMALL_FILES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its files are fewer than those and small, so that few tasks would read them."""
    sc, files = df.sparkSession.sparkContext, df.inputFiles()
    if len(files) >= sc.defaultParallelism:
        return df
    path = sc._jvm.org.apache.hadoop.fs.Path
    size = sum(p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(sc.defaultParallelism) if 0 < size <= SMALL_FILES else df


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for a fifth of the ids; a null id counts as held out, so nothing is learned from it."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int
) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """Whole labelled texts for fitting a classifier: (doc_id, text, label), and rows by label.

    Of the labelled documents that are not held out and have a text of
    `max_chars` characters at most, those with the smallest hashes of doc_id
    are taken, `per_class` of each label at most; of rows with one doc_id the
    one whose text has the smallest hash. So the sample is bounded by
    2 * per_class * max_chars characters, whatever the size of the tables, and
    filled up from all documents there are. A document with several label rows
    takes the largest label. The class counts cover every labelled row.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("hash")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars) & ~held_out())
    # Labels and documents meet by id alone; texts are read again for the few that are picked.
    usable = texts.groupBy("doc_id").agg(F.min("hash").alias("hash")).join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    usable = cut(usable, "labelled")
    picked = [usable.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    found = texts.join(F.broadcast(picked[0].union(picked[1])), ["doc_id", "hash"])  # 2 * per_class rows at most
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    discard(usable)
    return sorted((r["doc_id"], r["text"], r["label"]) for r in rows), counts
