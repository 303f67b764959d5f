"""Statutes from search to store: exact hit, detail, articles, insert, vectors, and what became of each law."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators import discovery, store
from statuta.operators.rules import infer_tax_type
from statuta.options import DEFAULTS
from statuta.shared import cut
from statuta.sources import law_xml, providers

# Laws that are taken by default (their tax types have the same names), and the address of a law.
TARGETS = ("국세기본법", "소득세법", "법인세법", "부가가치세법", "상속세및증여세법", "조세특례제한법", "지방세법")
LAW_URL = "https://www.law.go.kr/lsInfoP.do?lsiSeq="
NO_HIT = "no law of exactly this name"
COUNTS = ("total_articles", "inserted_count", "skipped_count", "failed_count", "embedded_count", "embed_failed_count")


class Ingested(NamedTuple):
    articles: DataFrame
    new: DataFrame
    report: DataFrame


def targets(spark: SparkSession) -> DataFrame:
    """(target_idx, law_name, tax_type) of the default laws."""
    return spark.createDataFrame([(i, name, name) for i, name in enumerate(TARGETS)], "target_idx long, law_name string, tax_type string")


def found_targets(results: DataFrame) -> DataFrame:
    """The same of search results: laws of kept ministries, each mst once, numbered by where it was found."""
    laws = discovery.discover(results.where(F.col("mst").isNotNull()))
    # A keyword gives a few thousand results at most, so the two numbers fit into one.
    return laws.select((F.col("keyword_rank").cast("long") * 1_000_000 + F.col("position")).alias("target_idx"), "law_name", infer_tax_type(F.col("law_name")).alias("tax_type"))


def law_url(mst: Column) -> Column:
    return F.concat(F.lit(LAW_URL), mst)


def hits(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """wanted with mst and law_type of the first result of exactly its name; null where there is none."""
    named = discovery.first_of_each(results.where(F.col("mst").isNotNull()), "law_name", "position").select("law_name", "mst", "law_type")
    return wanted.join(named, "law_name", "left")


def ingest(wanted: DataFrame, results: DataFrame, details: DataFrame, stored: DataFrame, next_id: int, embedder: providers.Embedder | None = None, dimensions: int = DEFAULTS.dimensions) -> Ingested:
    """articles (with `status`), new ones (with id and vector), and a report row for each wanted law.

    wanted (target_idx, law_name, tax_type), results (position, law_name, mst,
    law_type), details (mst, raw_xml, error). A law without an exact hit or
    whose detail failed has an error and null counts; others go on. An article
    that lacks a part of its key has the status failed. Without an embedder
    nothing is embedded and those counts are 0.
    """
    laws = cut(hits(wanted, results).join(details, "mst", "left"), "laws")
    error = F.when(F.col("mst").isNull(), NO_HIT).otherwise(F.coalesce("error", F.when(F.col("raw_xml").isNull(), "no detail")))
    laws = laws.withColumn("error", error)
    sources = laws.where(F.col("error").isNull()).select("target_idx", "tax_type", law_url(F.col("mst")).alias("source_url"), "raw_xml", F.col("law_name").alias("name"), F.col("law_type").alias("type"))
    parsed = law_xml.parse_articles(sources, name_hint="name", type_hint="type", keys=("target_idx", "tax_type", "source_url"))
    parsed = parsed.withColumn("content_hash", T.content_hash(F.col("article_text"))).withColumn("place", F.struct("target_idx", "position"))
    articles = cut(store.insert_status(parsed, stored, order="place"), "articles")
    new = store.inserted(articles, next_id, order="place").withColumn("embedding", F.lit(None).cast("array<float>"))
    counts = articles.groupBy("target_idx").agg(F.count("*").alias("total_articles"), *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("inserted", "skipped", "failed")))
    if embedder is not None:
        new = cut(store.backfill(new, embeddings(new, embedder), dimensions), "embedded")
        done = F.col("embed_status") == "embedded"
        counts = counts.join(new.groupBy("target_idx").agg(F.count_if(done).alias("embedded_count"), F.count_if(~done).alias("embed_failed_count")), "target_idx", "left")
    report = laws.select("target_idx", "law_name", "mst", "error").join(counts, "target_idx", "left")
    zero = [F.when(F.col("error").isNull(), F.coalesce(F.col(c) if c in report.columns else F.lit(None), F.lit(0)).cast("long")).alias(c) for c in COUNTS]
    return Ingested(articles, new, report.select("target_idx", "law_name", "mst", *zero, "error"))


def embeddings(articles: DataFrame, embedder: providers.Embedder) -> DataFrame:
    """(id, embedding, error) of articles by their labelled text; calls are made once."""
    text = T.embed_text(*(F.col(c) for c in ("law_name", "law_type", "tax_type", "article_no", "article_title", "article_text")))
    return cut(providers.embed(articles.select("id", text.alias("text")), "text", "id", embedder), "vectors")


def backfill_pending(stored: DataFrame, embedder: providers.Embedder, dimensions: int = DEFAULTS.dimensions, tax_type: str | None = None) -> DataFrame:
    """stored with vectors for all current articles that have none, of one tax type if given, and `embed_status`."""
    todo = store.with_ids(stored, store.pending(stored, tax_type))
    return store.backfill(stored, embeddings(todo, embedder), dimensions)


def summary(report: DataFrame) -> DataFrame:
    """One row: laws, successes, errors, and the counts' sums over successes."""
    bad = F.col("error").isNotNull()
    return report.agg(
        F.count("*").alias("laws"),
        F.count_if(~bad).alias("success"),
        F.count_if(bad).alias("errors"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS),
    )


def failures(report: DataFrame) -> DataFrame:
    """(target_idx, law_name, error) of the laws that were not ingested."""
    return report.where(F.col("error").isNotNull()).select("target_idx", "law_name", "error")
