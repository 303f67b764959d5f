"""Queries of the pivot index, the memo of vectors, rules in thousands and pages of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import memo, pivots, retrieval, rule_automaton
from statuta.plans.digests import DIGEST_SQL, digest_vectors, shown
from statuta.plans.registry import LABEL, query
from statuta.shared import shared_path
from statuta.sources import law_api, tables
from statuta.sources.tables import LAW_SQL, read


@query(
    f"""WITH {LAW_SQL}, qs AS (SELECT item_id AS question_id, CASE WHEN item_id % 3 = 0 THEN '{LABEL}' END AS label, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
pairs AS (SELECT question_id, id, list_cosine_similarity(embedding, v) AS sim FROM law, qs WHERE is_current AND embedding IS NOT NULL AND (label IS NULL OR tax_type = label))
SELECT question_id, id, round(sim, 4) AS similarity_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(sim, 9) DESC, id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 10"""
)
def pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest current articles of each benchmark item, a third of which ask for one tax type only, by the index."""
    path = shared_path(spark, "pivots")
    pivots.build(retrieval.law_candidates(tables.law_articles(spark, sf_dir)), path, 64, others=["tax_type"])
    asked = tables.questions(spark, sf_dir).withColumn("label", F.when(F.col("question_id") % 3 == 0, LABEL))
    found = pivots.search(spark, path, asked, 10, same=[("tax_type", "label")]).nearest
    return found.select("question_id", "id", F.round("similarity", 4).alias("similarity_score"), "rank")


@query(f"SELECT doc_id, {DIGEST_SQL.format('''coalesce(text, '')''')} AS vector, TRUE AS embedded FROM documents")
def embed_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents through a memo that half of them have filled before, and that was compacted."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = memo.Memo(spark, shared_path(spark, "memo"), "digest/8")
    made.embed(documents.where(F.col("doc_id") % 2 == 0), "text", "doc_id", digest_vectors)
    made.compact()
    found = made.embed(documents, "text", "doc_id", digest_vectors)
    return found.select("doc_id", shown().alias("vector"), F.col("error").isNull().alias("embedded"))


@query(
    """WITH words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS keyword FROM benchmark), rules AS (SELECT keyword FROM words WHERE length(keyword) >= 5),
hits AS (SELECT doc_id, keyword FROM documents JOIN rules ON contains(text, keyword) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(keyword) DESC, keyword) = 1)
SELECT doc_id, coalesce(keyword, 'none') AS label FROM documents LEFT JOIN hits USING (doc_id)"""
)
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the benchmark's words, longest first, that each document contains."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("keyword")).where(F.length("keyword") >= 5).distinct()
    rules = rule_automaton.listed(words.select("keyword", F.col("keyword").alias("label"), (-F.length("keyword")).alias("rank")))
    return read(spark, sf_dir, "documents").select("doc_id", rule_automaton.first_rule(F.col("text"), rules, F.lit("none")).alias("label"))


_PAGE = 4
_SEARCHED = "SELECT 'n' || c_nationkey AS keyword, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS position, CAST(c_custkey AS VARCHAR) AS mst, c_name AS law_name, c_mktsegment AS ministry FROM customer"


def _search_folder(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Customers as laws that a search for their nation finds, in pages; the folder of replies, and the keywords."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    found = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment", place.alias("position"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("total"))
    tags = (("법령일련번호", F.col("c_custkey").cast("string")), ("법령명한글", F.col("c_name")), ("소관부처명", F.col("c_mktsegment")))
    law = F.concat(F.lit("<law>"), *(F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>")) for t, c in tags), F.lit("</law>"))
    pages = found.groupBy("c_nationkey", (F.floor(F.col("position") / _PAGE) + 1).alias("page")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("position", law.alias("law")))).alias("laws"))  # _PAGE laws each
    xml = F.concat(F.lit("<LawSearch><totalCnt>"), F.col("total").cast("string"), F.lit("</totalCnt>"), F.array_join(F.transform("laws", lambda x: x["law"]), ""), F.lit("</LawSearch>"))
    folder = shared_path(spark, "pages")
    law_api.write_pages(pages.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("keyword"), "page", xml.alias("xml")), folder)
    keywords = read(spark, sf_dir, "customer").select("c_nationkey").distinct().orderBy("c_nationkey").collect()  # 25 nations
    return folder, ",".join(f"n{r['c_nationkey']}" for r in keywords)


@query(f"{_SEARCHED}")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, keywords = _search_folder(spark, sf_dir)
    spark.dataSource.register(law_api.LawSearchSource)
    found = spark.read.format("law_search").options(keywords=keywords, pages=folder, display=_PAGE, max_results=1_000_000).load()
    return found.select("keyword", "position", "mst", "law_name", "ministry")


@query(f"SELECT keyword, CAST(position - {_PAGE} AS INTEGER) AS position, mst, law_name, ministry FROM ({_SEARCHED}) WHERE position BETWEEN {_PAGE} AND {2 * _PAGE - 1}")
def search_one_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, keywords = _search_folder(spark, sf_dir)
    spark.dataSource.register(law_api.LawSearchSource)
    found = spark.read.format("law_search").options(keywords=keywords, pages=folder, page="2").load()
    return found.select("keyword", "position", "mst", "law_name", "ministry")


@query(f"{_SEARCHED}")
def search_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stream of pages, which is stopped and started again on its checkpoint."""
    folder, keywords = _search_folder(spark, sf_dir)
    spark.dataSource.register(law_api.LawSearchSource)
    out, at = shared_path(spark, "found"), shared_path(spark, "search-checkpoint")
    for _ in range(2):
        pages = spark.readStream.format("law_search").options(keywords=keywords, pages=folder, display=_PAGE, max_results=1_000_000).load()
        stream = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema(law_api.SCHEMA).parquet(out).select("keyword", "position", "mst", "law_name", "ministry")
