"""Retrieval over statutes and user documents, merged by authority, threshold and rank.

Of each source the k nearest rows are taken, similarities are rounded to four
digits, rows under the threshold go, and the rest is ordered by priority,
similarity, source (statutes first) and rank, and cut to k. So statutes stand
before documents whatever their similarity, and nothing fills a gap that the
threshold leaves.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import or_else
from statuta.operators import rules
from statuta.operators.vector import batch_top_k, scoped_top_k, top_k
from statuta.options import DEFAULTS

DIGITS = 4
# The sentence of an empty context, what stands between entries, the mark of a category.
NOT_FOUND, SEPARATOR, PIN = "관련 문서를 찾지 못했습니다.", "\n\n---\n\n", "📌"
RESULT = ("content", "source", "law_name", "category", "source_type", "similarity_score", "priority")


def law_candidates(law: DataFrame, label: str | None = None) -> DataFrame:
    """Current embedded articles, of one tax type if a label other than ALL is given."""
    rows = law.where(F.col("is_current") & F.col("embedding").isNotNull())
    return rows if label in (None, rules.ALL) else rows.where(F.col("tax_type") == label)


def document_candidates(documents: DataFrame, user_id: str | None, label: str | None = None) -> DataFrame:
    """Embedded chunks of one user, of one law if a label other than ALL is given."""
    if not user_id:
        raise ValueError("user_id is required")
    rows = documents.where(F.col("embedding").isNotNull() & (F.col("user_id") == user_id))
    return rows if label in (None, rules.ALL) else rows.where(F.col("metadata.law_name") == label)


def tenant(user_id: str) -> str:
    """The id of a user in its usual form; ValueError if it is none."""
    return str(uuid.UUID(user_id))


def law_result() -> list[Column]:
    head = F.when(F.coalesce("article_title", F.lit("")) == "", F.col("article_no")).otherwise(F.concat("article_no", F.lit(" ["), "article_title", F.lit("]")))
    return [
        F.concat(head, F.lit("\n"), F.col("article_text")).alias("content"),
        or_else(F.col("source_url"), F.col("law_name")).alias("source"),
        F.col("law_name"),
        F.col("law_type").alias("category"),
        rules.lookup(F.col("law_type"), rules.LAW_SOURCE, rules.LAW_SOURCE_DEFAULT).alias("source_type"),
        rules.lookup(F.col("law_type"), rules.LAW_PRIORITY, rules.LAW_PRIORITY_DEFAULT).alias("priority"),
    ]


def document_result() -> list[Column]:
    category = F.coalesce("metadata.category", F.lit(rules.OTHER_CATEGORY))
    return [
        F.col("content"),
        F.coalesce("metadata.source", F.lit("")).alias("source"),
        F.coalesce("metadata.law_name", F.lit("")).alias("law_name"),
        category.alias("category"),
        rules.lookup(category, rules.CATEGORY_SOURCE, rules.CATEGORY_SOURCE_DEFAULT).alias("source_type"),
        rules.lookup(category, rules.CATEGORY_PRIORITY, rules.CATEGORY_PRIORITY_DEFAULT).alias("priority"),
    ]


def _source(found: DataFrame, columns: list[Column], place: int, keys: Sequence[str] = ()) -> DataFrame:
    return found.select(*keys, *columns, F.round("similarity", DIGITS).alias("similarity_score"), F.lit(place).alias("place"), F.col("rank").alias("source_rank"))


def _merge(results: DataFrame, threshold: float, k: int, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("priority", F.desc("similarity_score"), "place", "source_rank")
    kept = results.where(F.col("similarity_score") >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select(*keys, "rank", *RESULT)


def hybrid_search(law: DataFrame, documents: DataFrame, vector: Sequence[float], user_id: str, label: str | None = None, k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.similarity_threshold) -> DataFrame:
    """(rank, content, source, law_name, category, source_type, similarity_score, priority) for one question."""
    statutes = _source(top_k(law_candidates(law, label), vector, k), law_result(), 0)
    chunks = _source(top_k(document_candidates(documents, user_id, label), vector, k), document_result(), 1)
    return _merge(statutes.unionByName(chunks), threshold, k, ())


def batch_hybrid_search(law: DataFrame, documents: DataFrame, questions: DataFrame, k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.similarity_threshold, scoped: bool = False) -> DataFrame:
    """The same for many questions (question_id, embedding) over all labels and users.

    If scoped, each question (also label, user_id) sees its tax type's articles
    only, and of its user's chunks those of its law, or all of them for ALL. One
    without a user sees no chunks.
    """
    chunks = documents.where(F.col("embedding").isNotNull())
    if scoped:
        label = F.when(F.col("label") != rules.ALL, F.col("label"))
        best_law = batch_top_k(law_candidates(law), questions, k, same=[("tax_type", label)])
        asked = questions.where(F.coalesce("user_id", F.lit("")) != "")
        best_chunks = scoped_top_k(chunks.withColumn("_law", F.col("metadata.law_name")), asked, k, ("user_id", F.col("user_id")), same=[("_law", label)])
    else:
        best_law, best_chunks = batch_top_k(law_candidates(law), questions, k), batch_top_k(chunks, questions, k)
    keys = ["question_id"]
    statutes = _source(law.join(best_law, "id"), law_result(), 0, keys)
    chunks = _source(documents.join(best_chunks, "id"), document_result(), 1, keys)
    return _merge(statutes.unionByName(chunks), threshold, k, keys)


def _entries() -> Column:
    entry = F.format_string(f"[출처: %s | %s | {PIN} %s (%s)]\n%s", "source", "law_name", "category", "source_type", "content")
    return F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("entries")


def contexts(results: DataFrame, key: str) -> DataFrame:
    """(key, context) of the keys that have results."""
    return results.groupBy(key).agg(_entries()).select(key, F.array_join(F.transform("entries", lambda e: e["entry"]), SEPARATOR).alias("context"))


def context(results: DataFrame) -> DataFrame:
    """One row: the results as one text for a prompt; a fixed sentence if there are none."""
    entries = results.agg(_entries())
    joined = F.array_join(F.transform("entries", lambda e: e["entry"]), SEPARATOR)
    return entries.select(F.when(F.size("entries") == 0, NOT_FOUND).otherwise(joined).alias("context"))
