"""Operator 10: token counts as delta-maintained rollups.

A change is a signed row: +1 inserts a document's count, -1 takes a count
back; a revised count is both. A batch of changes is summed by key (source,
lang, tokenizer_version) before the shuffle and committed as one folder,
`batch=<id>`, under the store's path. Spark's commit makes the folder whole at
once (its _SUCCESS file comes last), and a batch that is already committed is
not written again, so a retried or repeated batch changes nothing. Totals are
the sum over the committed batches; compact() folds them into one snapshot,
whose rows carry the ids of the batches in it, so that these stay committed.

Defined cases: null source, lang or version are keys of their own; a null count
adds no tokens but counts as a document; null signs count as +1; repeated rows
each count, those of a null doc_id too; keys whose totals are all zero are left out of totals(); an empty
batch is committed as an empty one; columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, shared_path, table

KEYS = ("source", "lang", "tokenizer_version")
SNAPSHOT = "snapshot"
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def summed(changes: DataFrame) -> DataFrame:
    """Additive totals of signed rows, by key."""
    sign = F.coalesce(F.col("sign").cast("long"), F.lit(1).cast("long"))
    return changes.groupBy(*KEYS).agg(
        F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))).alias("n_tokens")
    )


class Rollup:
    """Totals by key under one path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.toString() for p in found if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def committed(self) -> set[str]:
        """Ids of all batches, those folded into a snapshot too."""
        found = {p.rpartition("batch=")[2] for p in self._committed()}
        if SNAPSHOT in found:
            ledger = self.spark.read.schema("batch string").parquet(f"{self.path}/batch={SNAPSHOT}").where("batch IS NOT NULL")
            found = found - {SNAPSHOT} | {r["batch"] for r in ledger.collect()}  # an id each, as commit() lists them
        return found

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer_version, n_tokens, sign); False if it had been committed before."""
        if not batch or "/" in batch or batch == SNAPSHOT:
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        paths = self._committed()
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        deltas = self.spark.read.schema(SCHEMA).parquet(*paths).where("n_docs IS NOT NULL")
        totals = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return totals.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self, path: str) -> Rollup:
        """A new store with the same totals and the same committed ids in one folder, which Spark's commit makes whole at once."""
        new = Rollup(self.spark, path)
        if new.committed():
            raise ValueError(f"{path} holds a store already")
        ids = self.spark.createDataFrame([(b,) for b in sorted(self.committed())], "batch string")
        self.totals().unionByName(ids, allowMissingColumns=True).write.mode("overwrite").parquet(f"{new.path}/batch={SNAPSHOT}")
        return new


#: Counting rules by tokenizer version, as regular expressions of one token that Spark and DuckDB read alike.
VERSIONS: Mapping[str, str] = {"words-1": r"[^ \t\n\r\f]+", "pieces-2": r"[0-9A-Za-z]+|[^ 0-9A-Za-z\t\n\r\f]+"}


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under words-1 in two batches, then one of revisions and one of deletions.

    Documents with doc_id mod 3 = 1 are revised to pieces-2, and those with
    doc_id mod 11 = 5 deleted. Batches are committed twice, which changes nothing.
    """
    documents = table(spark, sf_dir, "documents")
    revised, deleted = F.col("doc_id") % 3 == 1, F.col("doc_id") % 11 == 5
    counts = cut(
        documents.select(
            "doc_id", "source", "lang", count_tokens(F.col("text"), "words-1").alias("first"),
            F.when(revised, count_tokens(F.col("text"), "pieces-2")).alias("second"),
        )
    )

    def rows(where: Column, version: str, sign: int) -> DataFrame:
        column = "first" if version == "words-1" else "second"
        return counts.where(where).select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col(column).alias("n_tokens"), F.lit(sign).alias("sign"))

    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    batches = {
        "1-insert": rows(~odd, "words-1", 1),
        "2-insert": rows(odd, "words-1", 1),
        "3-revise": rows(revised, "words-1", -1).unionByName(rows(revised, "pieces-2", 1)),
        "4-delete": rows(deleted & ~revised, "words-1", -1).unionByName(rows(deleted & revised, "pieces-2", -1)),
    }
    store = Rollup(spark, shared_path(spark, "rollup"))
    for batch, changes in batches.items():
        store.commit(batch, changes)
    store.commit("3-revise", batches["3-revise"])
    return store.totals()


OP10_SQL = rf"""
SELECT source, lang, CASE WHEN doc_id % 3 = 1 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer_version,
  count(*) AS n_docs,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), CASE WHEN doc_id % 3 = 1 THEN '{VERSIONS["pieces-2"]}' ELSE '{VERSIONS["words-1"]}' END))) AS BIGINT) AS n_tokens
FROM documents WHERE doc_id IS NULL OR doc_id % 11 <> 5 GROUP BY 1, 2, 3
"""
