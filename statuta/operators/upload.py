"""Uploaded files from text to chunks in the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators import chunking, store
from statuta.operators.rules import FILE_CATEGORY_RULES, FILE_LAW_RULES, Rules, classify_file
from statuta.options import DEFAULTS
from statuta.shared import cut
from statuta.sources import providers

REPLY = "category string, law_name string"


def classify_reply(filename: Column, reply: Column, category_rules: Rules = FILE_CATEGORY_RULES, law_rules: Rules = FILE_LAW_RULES) -> tuple[Column, Column]:
    """(category, law) of a file by rule, else by the fields of a model's JSON reply, else the defaults.

    A field of the reply is taken as it stands, known label or not; a reply that
    is no JSON object, or lacks the field, gives the default.
    """
    parsed = F.from_json(reply, REPLY, {"mode": "PERMISSIVE"})
    return classify_file(filename, parsed["category"], parsed["law_name"], category_rules, law_rules)


def chunk_metadata(source: Column, law_name: Column, category: Column, uploader: Column, chunk_index: Column) -> Column:
    """A file's metadata with the number of one chunk."""
    return F.struct(source.alias("source"), law_name.alias("law_name"), category.alias("category"), uploader.alias("uploader"), chunk_index.alias("chunk_index"))


def upload(
    files: DataFrame,
    documents: DataFrame,
    embedder: providers.Embedder,
    max_bytes: int = DEFAULTS.max_upload_bytes,
    category_rules: Rules = FILE_CATEGORY_RULES,
    law_rules: Rules = FILE_LAW_RULES,
    size: int = DEFAULTS.chunk_size,
    overlap: int = DEFAULTS.chunk_overlap,
    tokenizer: chunking.Tokenizer | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents with the files' chunks in place of former ones, report) of files (file_id, path, length, text, user_id, uploader, reply).

    The report has a row for each file: file_id, filename, reject_code,
    category, law_name, chunks_stored, status (ok, rejected or failed). A file
    of which any chunk got no vector is not stored and keeps its former chunks;
    so does one that gives no chunk at all, which is rejected with code 422.
    Of several accepted files of one name and user the one of the highest
    file_id is stored; the others are replaced by it.
    """
    category, law = classify_reply(F.col("path"), F.col("reply"), category_rules, law_rules)
    checked = cut(store.guard_upload(files, max_bytes).withColumn("category", category).withColumn("law_name", law), "files")
    cuts = chunking.chunk(checked.where(F.col("reject_code").isNull()), "text", ["file_id"], size, overlap, tokenizer)
    chunks = cut(cuts.withColumn("chunk_id", F.concat_ws(":", "file_id", "chunk_index")), "chunks")
    vectors = cut(providers.embed(chunks, "content", "chunk_id", embedder), "vectors")
    whole = chunks.join(vectors, "chunk_id")
    fate = whole.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("lost"))
    code = F.coalesce("reject_code", F.when(F.col("n").isNull(), 422))
    state = F.when(F.col("reject_code").isNotNull(), "rejected").when(F.col("lost") > 0, "failed").otherwise("ok")
    report = cut(checked.drop("text").join(fate, "file_id", "left").withColumn("reject_code", code).withColumn("status", state), "report")
    ok = report.where(F.col("status") == "ok")
    latest = ok.groupBy("path", "user_id").agg(F.max_by("file_id", "file_id").alias("file_id"))
    kept = ok.join(latest.select("file_id"), "file_id", "left_semi")
    meta = chunk_metadata(F.col("path"), F.col("law_name"), F.col("category"), F.col("uploader"), F.col("chunk_index"))
    rows = whole.join(kept.select("file_id", "path", "law_name", "category", "uploader", "user_id"), "file_id").select("content", "embedding", meta.alias("metadata"), "user_id")
    names = latest.select(F.col("path").alias("_source"), F.col("user_id").alias("_user"))
    keyed = documents.withColumn("_source", F.col("metadata.source")).withColumn("_user", F.col("user_id"))
    left = keyed.join(names, ["_source", "_user"], "left_anti").drop("_source", "_user")
    stored = F.when(F.col("status") == "ok", F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return left.unionByName(rows, allowMissingColumns=True), report.select("file_id", F.col("path").alias("filename"), "reject_code", "category", "law_name", stored.alias("chunks_stored"), "status")
