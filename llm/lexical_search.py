"""Operator 12: ranked lexical search over term-bucketed postings, in integers.

Documents are inverted in blocks of up to BLOCK rows: a row of the index is the
bucket of one term within one block, with the place, doc_id, occurrences and
length of each document that holds it. A term of all documents so stands in as
many buckets as there are blocks, and a document's postings in one block. The
index is written once; document frequencies and the corpus's figures are read
from its narrow columns.

A search deals the buckets out by block, joins the items' weighted terms,
scores each match, sums by item and document inside the block, and ranks. Only
the best of each task go on to the final ranking.

Items are a stated set of queries. Their terms are sent to the tasks, in rounds
of about ITEM_TERMS rows if there are more, each of which reads the documents
once.

Defined cases: a null or empty text has no term, is no document of the corpus
and matches nothing; rows that share a doc_id are documents of their own and
can both be ranked; a null doc_id comes first among equal scores; rows of one
item_id are one item, a null item_id included; an empty table on either side
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, dealt, discard, table

#: Documents in a block, and bytes of their texts unless one alone has more; items' terms in a round.
BLOCK, BLOCK_BYTES, ITEM_TERMS = 500, 16 << 20, 100_000
TOP_K = 50
#: All signs but ASCII letters and figures and what lies beyond ASCII.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same for bytes of UTF-8: what is no term becomes a space.
BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
INDEX = "block long, term int, postings array<struct<place:int,doc_id:long,tf:long,n:long>>, size long, length long"


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.filter(F.split(F.translate(text, CAPITALS, CAPITALS.lower()), NO_TERM, -1), lambda t: t != "")


class Inverted:
    """Buckets of one block of documents."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers, self.docs, self.lengths = numbers, [], []
        self.term, self.place, self.tf = [], [], []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = (text or "").encode().translate(BYTES).split()
        if not words:
            return
        get, counts = self.numbers.get, {}
        for word in words:
            if (term := get(word)) is not None:
                counts[term] = counts.get(term, 0) + 1
        self.term += counts.keys()
        self.tf += counts.values()
        self.place += [len(self.docs)] * len(counts)
        self.docs.append(doc_id)
        self.lengths.append(len(words))
        self.bytes += len(text)

    def batch(self, block: int) -> pa.RecordBatch:
        """A row for each term, and one under term -1 with how many documents and terms the block has."""
        term, place = np.array(self.term, np.int32), np.array(self.place, np.int32)
        order = np.argsort(term, kind="stable")
        found, first = np.unique(term[order], return_index=True)
        place = place[order]
        postings = pa.StructArray.from_arrays(
            [pa.array(place), pa.array(self.docs, pa.int64()).take(pa.array(place)), pa.array(np.array(self.tf, np.int64)[order]), pa.array(np.array(self.lengths, np.int64)[place])], ["place", "doc_id", "tf", "n"]
        )
        ends = np.append(first, [len(order)] * 2).astype(np.int32)  # the last bucket is empty
        size = np.append(np.diff(ends[:-1]), len(self.docs))
        length = np.append(np.zeros(len(found), np.int64), sum(self.lengths))
        columns = [pa.array(np.full(len(found) + 1, block)), pa.array(np.append(found, -1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), postings), pa.array(size.astype(np.int64)), pa.array(length)]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "postings", "size", "length"])


def index(documents: DataFrame, words: list[str]) -> DataFrame:
    """Term buckets (block, term, postings, size, length) of those words in all documents; `term` is a word's place in the list.

    Term -1 stands for a block itself: its documents with any term and all their terms, listed words or not.
    """
    numbers = documents.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, made = TaskContext.get().partitionId() << 32, Inverted(numbers.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                made.add(doc_id, text.as_py())
                if len(made.docs) >= BLOCK or made.bytes >= BLOCK_BYTES:
                    yield made.batch(block)
                    block, made = block + 1, Inverted(numbers.value)
        if made.docs:
            yield made.batch(block)

    return dealt(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, INDEX)


def ranked(buckets: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for a written index and its items' terms (item_id, term): the k best documents of each item."""
    whole = buckets.where(F.col("term") == -1).agg(F.sum("size").alias("docs"), F.sum("length").alias("terms")).head()
    docs, length = F.lit(whole["docs"] or 0), F.lit(whole["terms"] or 1)
    frequency = buckets.where(F.col("term") >= 0).groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = wanted.join(F.broadcast(frequency), "term").select("item_id", "term", weight.alias("w"))  # a row for each term of a round at most
    matches = buckets.where(F.col("term") >= 0).select("block", "term", "postings").repartition("block").join(F.broadcast(weighted), "term")
    matches = matches.select("block", "item_id", "w", F.inline("postings")).withColumn("docs", docs).withColumn("terms", length)
    matches = matches.withColumn("m", F.expr("100 - 50 + (50 * n * docs) div terms"))
    scored = matches.groupBy("block", "item_id", "place", "doc_id").agg(F.expr("sum(w * ((1000000000 * tf) div (1000 * tf + 20 * m)))").alias("score")).where(F.col("score") > 0)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "block", "place")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = TOP_K, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = documents.sparkSession
    asked = cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("word")).distinct(), "item-terms")
    rounds = max(1, -(-asked.count() // item_terms))
    found = []
    for i in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i)
        words = sorted(r["word"] for r in mine.select("word").distinct().collect())
        numbers = spark.createDataFrame(list(enumerate(words)), "term int, word string")
        buckets = cut(index(documents, words), "postings")
        found.append(cut(ranked(buckets, mine.join(F.broadcast(numbers), "word").select("item_id", "term"), k), "ranked"))
        discard(buckets)
    discard(asked)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
postings AS (SELECT word, doc_id, count(*) AS tf FROM words WHERE word IN (SELECT word FROM wanted) GROUP BY 1, 2),
weights AS (SELECT word, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY word, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN postings USING (word) JOIN weights USING (word) JOIN lengths USING (doc_id), whole GROUP BY 1, 2
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
