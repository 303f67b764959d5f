"""The engine's tables over the benchmark's: statutes from documents, user documents from pages, logs from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAW_TYPES = ("법률", "대통령령", "총리령", "부령", "조례")
CATEGORIES = ("법령", "시행령", "시행규칙", "집행기준", "기타")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def law_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("law_name"),
        of(LAW_TYPES, F.col("n_chars")).alias("law_type"),
        F.col("lang").alias("tax_type"),
        F.concat(F.lit("제"), F.col("doc_id").cast("string"), F.lit("조")).alias("article_no"),
        F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("").alias("article_title"),
        F.col("text").alias("article_text"),
        F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.concat(F.lit("https://law.example/"), F.col("doc_id").cast("string"))).alias("source_url"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash"),
        "embedding",
        (F.col("source") != "src7").alias("is_current"),
    )


LAW_SQL = """law AS (
  SELECT doc_id AS id, source AS law_name,
    (['법률', '대통령령', '총리령', '부령', '조례'])[n_chars % 5 + 1] AS law_type,
    lang AS tax_type, '제' || doc_id || '조' AS article_no,
    CASE WHEN n_chars % 2 = 0 THEN lang ELSE '' END AS article_title, text AS article_text,
    CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'https://law.example/' || doc_id END AS source_url,
    sha256(text) AS content_hash, CAST(embedding AS DOUBLE[]) AS embedding, source <> 'src7' AS is_current
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id
)"""


def user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = read(spark, sf_dir, "pages"), read(spark, sf_dir, "embeddings")
    n = F.length("html")
    category = F.when(n % 6 < 5, F.element_at(F.array(*map(F.lit, CATEGORIES)), F.least(n % 6, F.lit(4)) + 1))
    return p.join(e.select(F.col("vec_id").alias("page_id"), "embedding"), "page_id", "left").select(
        F.col("page_id").alias("id"),
        F.col("html").alias("content"),
        "embedding",
        F.struct(
            F.regexp_extract("url", r"//([^/]+)/", 1).alias("source"),
            F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("law_name"),
            category.alias("category"),
            F.lit("loader").alias("uploader"),
            F.lit(0).alias("chunk_index"),
        ).alias("metadata"),
        F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("created_at"),
    )


DOCS_SQL = r"""docs AS (
  SELECT page_id AS id, html AS content, CAST(embedding AS DOUBLE[]) AS embedding,
    regexp_extract(url, '//([^/]+)/', 1) AS source, regexp_extract(url, '/([a-z]{2})/', 1) AS law_name,
    CASE WHEN length(html) % 6 < 5 THEN (['법령', '시행령', '시행규칙', '집행기준', '기타'])[length(html) % 6 + 1] END AS category,
    regexp_extract(url, 'example\.([a-z]+)', 1) AS user_id,
    make_timestamp((1700000000 + page_id) * 1000000) AS created_at
  FROM pages LEFT JOIN embeddings ON vec_id = page_id
)"""


def chat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.struct("role", F.col("text").alias("content")).alias("message"), F.lit(0).alias("created_at")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each with the vector of its number."""
    b, e = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "embeddings")
    return b.join(e.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id").select(F.col("item_id").alias("question_id"), "text", "embedding")
