"""Queries of streams that arrive in rounds, and of the store in buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import buckets, store, vector
from statuta.plans.registry import USER, query
from statuta.shared import shared_path
from statuta.sources import tables
from statuta.sources.tables import DOCS_SQL, LAW_SQL, read
from statuta.streaming import ingest, sse, think_filter


def _rounds(rows: DataFrame, early: Column) -> list[DataFrame]:
    """Two tables that arrive one after the other."""
    return [rows.where(early), rows.where(~early)]


def _line(content: Column, done: Column) -> Column:
    return F.to_json(F.struct(F.struct(content.alias("content")).alias("message"), done.alias("done")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as streams of two chunks a turn, the first behind a thought in two of three streams; the last says done."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id")
    turns = turns.withColumn("first", F.col("turn") == F.min("turn").over(by)).withColumn("last", F.col("turn") == F.max("turn").over(by))
    whole = F.when(F.col("first") & (F.col("conv_id") % 3 > 0), F.concat(F.lit("<think>hidden</think>"), F.col("text"))).otherwise(F.col("text"))
    at = (F.col("conv_id") % 20 + 1).cast("int")
    pieces = F.array(F.substr(whole, F.lit(1), at), F.substr(whole, at + 1))
    cut = turns.select(F.col("conv_id").cast("string").alias("stream_id"), "turn", "last", F.posexplode(pieces).alias("piece", "content"))
    return cut.select("stream_id", (F.col("turn") * 2 + F.col("piece")).cast("long").alias("seq"), "piece", "content", (F.col("last") & (F.col("piece") == 1)).alias("done"))


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS answer, 'done' AS ended FROM conversations GROUP BY 1")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers out of streams whose first chunks, with half of a think mark, come a round before the others."""
    lines = _turns(spark, sf_dir)
    first = F.col("seq") == F.min("seq").over(Window.partitionBy("stream_id"))
    lines = lines.select("stream_id", "seq", _line(F.col("content"), F.col("done")).alias("line"), first.alias("early"))
    return ingest.in_rounds([part.drop("early") for part in _rounds(lines, F.col("early"))], think_filter.answer_stream, "answers")


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS answer FROM conversations GROUP BY 1")
def think_filter_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams at once, with blank and broken lines between, and lines behind the end."""
    turns, bad = _turns(spark, sf_dir), F.element_at(F.array(*map(F.lit, ("", "{", "[1]", "no json", "null"))), (F.col("seq") % 5 + 1).cast("int"))
    good = turns.select("stream_id", (F.col("seq") * 2).alias("seq"), _line(F.col("content"), F.col("done")).alias("line"))
    late = turns.where("done").select("stream_id", (F.col("seq") * 2 + 2).alias("seq"), _line(F.lit("late"), F.lit(False)).alias("line"))
    return think_filter.answers(think_filter.filter_batch(good.union(turns.select("stream_id", F.col("seq") * 2 + 1, bad)).union(late)))


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 2 - 2 AS INTEGER) AS place, coalesce(text, '') AS chunk FROM conversations")
def sse_stream_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with noise between them, each cut in two at a changing place; streams of odd numbers go on a round later in the midst of an event."""
    chunks = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("chunk"))
    events = think_filter.sse_rows(chunks).withColumn("event", F.concat("event", F.lit("noise\n\n")))
    at = (F.crc32(F.encode(F.concat("stream_id", F.col("seq").cast("string")), "utf-8")) % (F.length("event") + 1)).cast("int")
    pieces = events.select("stream_id", "seq", F.posexplode(F.array(F.substr("event", F.lit(1), at), F.substr("event", at + 1))).alias("half", "piece"))
    pieces = pieces.select("stream_id", (F.col("seq") * 2 + F.col("half")).alias("seq"), "piece")
    middle = F.col("seq") <= F.avg("seq").over(Window.partitionBy("stream_id"))
    pieces = pieces.withColumn("early", (F.col("stream_id").cast("long") % 2 == 0) | middle)
    return ingest.in_rounds([part.drop("early") for part in _rounds(pieces, F.col("early"))], sse.parse_stream, "events")


_CHANGES = """a AS (SELECT doc_id AS position, lang AS law_name, source AS article_no, md5(left(text, 1 + doc_id % 3)) AS content_hash FROM documents WHERE doc_id IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY law_name, article_no, content_hash ORDER BY position) = 1 AS fresh, law_name IS NULL OR article_no IS NULL OR content_hash IS NULL AS failed FROM a),
  v AS (SELECT law_name, article_no, content_hash, CAST(row_number() OVER (PARTITION BY law_name, article_no ORDER BY position) AS INTEGER) AS version FROM f WHERE fresh AND NOT failed)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles that come again and again, the half with smaller ids a round earlier."""
    digest = F.md5(F.encode(F.expr("left(text, cast(1 + doc_id % 3 as int))"), "utf-8"))
    articles = read(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("position"), F.col("lang").alias("law_name"), F.col("source").alias("article_no"), digest.alias("content_hash"))
    middle = articles.agg(F.avg("position")).head()[0] or 0.0
    return ingest.in_rounds(_rounds(articles, F.col("position") <= middle), ingest.changes, "changes")


@query(f"""WITH {_CHANGES} SELECT position, f.law_name, f.article_no, f.content_hash, CASE WHEN failed THEN 'failed' WHEN fresh THEN 'inserted' ELSE 'skipped' END AS status, version
FROM f LEFT JOIN v ON f.law_name = v.law_name AND f.article_no = v.article_no AND f.content_hash = v.content_hash""")
def article_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {_CHANGES} SELECT law_name, article_no, content_hash, version, version = max(version) OVER (PARTITION BY law_name, article_no) AS is_current FROM v")
def article_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.current(_changes(spark, sf_dir).where(F.col("status") == "inserted")).select("law_name", "article_no", "content_hash", "version", "is_current")


@query(
    f"""WITH {DOCS_SQL}, named AS (SELECT 'page' || id % 50 || '.PDF' AS source, user_id, 0 AS i FROM docs),
gone AS (SELECT DISTINCT source, user_id FROM named WHERE source LIKE 'page1%')
SELECT source, user_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS indexes FROM (
  SELECT * FROM named WHERE source NOT LIKE 'page1%'
  UNION ALL SELECT source, user_id, unnest([7, 8]) FROM gone WHERE source <> 'page11.PDF'
  UNION ALL SELECT 'page1new.PDF', '{USER}', 7) GROUP BY ALL"""
)
def upload_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in buckets in which some files get two chunks each, one loses its rows, and a new one comes."""
    named = F.col("metadata").withField("source", F.concat(F.lit("page"), (F.col("id") % 50).cast("string"), F.lit(".PDF")))
    documents = tables.user_documents(spark, sf_dir).withColumn("metadata", named)
    path = shared_path(spark, "store")
    buckets.write(documents, path, 16)
    old = documents.select("metadata.source", "user_id").where(F.col("source").startswith("page1")).distinct()
    new = spark.createDataFrame([("page1new.PDF", USER)], old.schema)
    two = old.where(F.col("source") != "page11.PDF").withColumn("i", F.explode(F.array(F.lit(7), F.lit(8)))).unionByName(new.withColumn("i", F.lit(7)))
    chunks = two.select(F.lit("new").alias("content"), F.struct("source", F.lit(None).cast("string").alias("law_name"), F.lit(None).cast("string").alias("category"), F.lit("u").alias("uploader"), F.col("i").alias("chunk_index")).alias("metadata"), "user_id")
    buckets.replace(spark, path, old.unionByName(new), chunks)
    rows = buckets.read(spark, path).select("metadata.source", "user_id", F.col("metadata.chunk_index").alias("i"))
    return rows.groupBy("source", "user_id").agg(F.count("*").alias("n"), F.sum("i").alias("indexes"))


@query(f"WITH {LAW_SQL} SELECT law_name, article_no, id, CAST(row_number() OVER (PARTITION BY law_name ORDER BY article_no NULLS FIRST, id) AS INTEGER) AS place FROM law WHERE is_current")
def articles_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.in_order(tables.law_articles(spark, sf_dir).where("is_current"), ["law_name"], ["article_no", "id"]).select("law_name", "article_no", "id", "place")


@query(f"WITH {LAW_SQL} SELECT id, law_name, article_no, CAST(row_number() OVER (PARTITION BY tax_type ORDER BY id) AS INTEGER) AS place FROM law WHERE embedding IS NULL AND is_current")
def pending_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that wait for a vector, in order of their ids within a tax type."""
    law = tables.law_articles(spark, sf_dir)
    return store.in_order(store.with_ids(law, store.pending(law)), ["tax_type"], ["id"]).select("id", "law_name", "article_no", "place")


@query("SELECT vec_id AS id, vec_id % 3 = 2 AND coalesce(list_sum(list_transform(embedding, lambda x: x * x)) > 0, FALSE) AS measured FROM embeddings")
def vectors_without_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which a third is made null and a third zero: only the others have a similarity."""
    made = F.when(F.col("vec_id") % 3 == 0, F.lit(None)).when(F.col("vec_id") % 3 == 1, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), made.alias("v"))
    return rows.select("id", vector.cosine_similarity(F.col("v"), F.col("v")).isNotNull().alias("measured"))


@query(f"WITH {LAW_SQL} SELECT id, CASE WHEN embedding IS NULL AND id % 2 = 0 THEN 'embedded' WHEN embedding IS NULL THEN 'missing' ELSE 'kept' END AS embed_status, embedding IS NULL AND id % 2 = 0 AS newer FROM law")
def backfill_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows have a new updated_at when every second pending one got a vector."""
    law = tables.law_articles(spark, sf_dir).withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    vectors = store.pending(law.withColumn("is_current", F.lit(True))).where(F.col("id") % 2 == 0).withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    made = store.backfill(law, vectors, 2)
    return made.select("id", "embed_status", (F.col("updated_at") > F.timestamp_seconds(F.lit(0))).alias("newer"))
