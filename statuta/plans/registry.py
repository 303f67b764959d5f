"""Queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators import chunking, conversation, discovery, retrieval, rules, store, vector
from statuta.sources import tables
from statuta.sources.tables import DOCS_SQL, LAW_SQL, read
from statuta.streaming import think_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION, USER, LABEL = 1, "com", "en"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- retrieval


def question_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUESTION) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head()["embedding"]


_Q = f"q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {QUESTION})"
_LAW_PRIORITY = "CASE law_type WHEN '법률' THEN 0 WHEN '대통령령' THEN 1 ELSE 2 END"
_LAW_SOURCE = "CASE law_type WHEN '법률' THEN 'law' WHEN '대통령령' THEN 'regulation' WHEN '총리령' THEN 'rule' WHEN '부령' THEN 'rule' ELSE 'law' END"
_CAT_PRIORITY = "CASE coalesce(category, '기타') WHEN '법령' THEN 3 WHEN '시행령' THEN 4 WHEN '시행규칙' THEN 5 WHEN '집행기준' THEN 6 ELSE 7 END"
_CAT_SOURCE = "CASE coalesce(category, '기타') WHEN '법령' THEN 'law' WHEN '시행령' THEN 'regulation' WHEN '시행규칙' THEN 'rule' WHEN '집행기준' THEN 'practice_pdf' ELSE 'user_pdf' END"
_LAW_CONTENT = "article_no || CASE WHEN article_title = '' THEN '' ELSE ' [' || article_title || ']' END || chr(10) || article_text"


def _law_top(where: str = "TRUE") -> str:
    return f"""law_top AS (
  SELECT *, list_cosine_similarity(embedding, v) AS sim, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding, v), 9) DESC, id) AS source_rank
  FROM law, q WHERE is_current AND embedding IS NOT NULL AND {where} QUALIFY source_rank <= 10)"""


def _doc_top(where: str = "TRUE") -> str:
    return f"""doc_top AS (
  SELECT *, list_cosine_similarity(embedding, v) AS sim, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding, v), 9) DESC, id) AS source_rank
  FROM docs, q WHERE embedding IS NOT NULL AND {where} QUALIFY source_rank <= 10)"""


def _hybrid(threshold: float, law: str = "TRUE", docs: str = "TRUE") -> str:
    return f"""WITH {LAW_SQL}, {DOCS_SQL}, {_Q}, {_law_top(law)}, {_doc_top(docs)}, both_sources AS (
  SELECT {_LAW_CONTENT} AS content, CASE WHEN source_url = '' THEN law_name ELSE source_url END AS source, law_name, law_type AS category,
    {_LAW_SOURCE} AS source_type, round(sim, 4) AS similarity_score, {_LAW_PRIORITY} AS priority, 0 AS place, source_rank FROM law_top
  UNION ALL SELECT content, source, law_name, coalesce(category, '기타'), {_CAT_SOURCE}, round(sim, 4), {_CAT_PRIORITY}, 1, source_rank FROM doc_top
), merged AS (
  SELECT *, CAST(row_number() OVER (ORDER BY priority, similarity_score DESC, place, source_rank) AS INTEGER) AS rank FROM both_sources WHERE similarity_score >= {threshold} QUALIFY rank <= 10
)"""


_RESULT = " SELECT rank, content, source, law_name, category, source_type, similarity_score, CAST(priority AS INTEGER) AS priority FROM merged"


@query(f"WITH {LAW_SQL}, {_Q}, {_law_top()} SELECT id, law_name, round(sim, 4) AS similarity_score, CAST(source_rank AS INTEGER) AS rank FROM law_top")
def law_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.top_k(retrieval.law_candidates(tables.law_articles(spark, sf_dir)), question_vector(spark, sf_dir), 10)
    return found.select("id", "law_name", F.round("similarity", 4).alias("similarity_score"), "rank")


@query(f"WITH {DOCS_SQL}, {_Q}, {_doc_top(f'''user_id = '{USER}' ''')} SELECT id, source, round(sim, 4) AS similarity_score, CAST(source_rank AS INTEGER) AS rank FROM doc_top")
def doc_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.top_k(retrieval.document_candidates(tables.user_documents(spark, sf_dir), USER), question_vector(spark, sf_dir), 10)
    return found.select("id", F.col("metadata.source").alias("source"), F.round("similarity", 4).alias("similarity_score"), "rank")


def _search(spark: SparkSession, sf_dir: str, threshold: float, label: str | None = None) -> DataFrame:
    return retrieval.hybrid_search(tables.law_articles(spark, sf_dir), tables.user_documents(spark, sf_dir), question_vector(spark, sf_dir), USER, label, threshold=threshold)


@query(_hybrid(0.2, docs=f"user_id = '{USER}'") + _RESULT)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 0.2)


flagship = hybrid_search


@query(_hybrid(0.4, docs=f"user_id = '{USER}'") + _RESULT)
def hybrid_search_default_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 0.4)


@query(_hybrid(0.1, f"tax_type = '{LABEL}'", f"user_id = '{USER}' AND law_name = '{LABEL}'") + _RESULT)
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 0.1, LABEL)


@query(
    _hybrid(0.2, docs=f"user_id = '{USER}'")
    + f""" SELECT coalesce(string_agg('[출처: ' || source || ' | ' || law_name || ' | 📌 ' || category || ' (' || source_type || ')]' || chr(10) || content,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '{retrieval.NOT_FOUND}') AS context FROM merged"""
)
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.context(_search(spark, sf_dir, 0.2))


_PAIRS = """qs AS (SELECT item_id AS question_id, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
law_all AS (SELECT question_id, law.*, list_cosine_similarity(embedding, v) AS sim, row_number() OVER (PARTITION BY question_id ORDER BY round(list_cosine_similarity(embedding, v), 9) DESC, id) AS source_rank
  FROM law, qs WHERE is_current AND embedding IS NOT NULL QUALIFY source_rank <= 10),
doc_all AS (SELECT question_id, docs.*, list_cosine_similarity(embedding, v) AS sim, row_number() OVER (PARTITION BY question_id ORDER BY round(list_cosine_similarity(embedding, v), 9) DESC, id) AS source_rank
  FROM docs, qs WHERE embedding IS NOT NULL QUALIFY source_rank <= 10)"""


@query(
    f"""WITH {LAW_SQL}, {DOCS_SQL}, {_PAIRS}, both_sources AS (
  SELECT question_id, {_LAW_CONTENT} AS content, CASE WHEN source_url = '' THEN law_name ELSE source_url END AS source, law_name, law_type AS category,
    {_LAW_SOURCE} AS source_type, round(sim, 4) AS similarity_score, {_LAW_PRIORITY} AS priority, 0 AS place, source_rank FROM law_all
  UNION ALL SELECT question_id, content, source, law_name, coalesce(category, '기타'), {_CAT_SOURCE}, round(sim, 4), {_CAT_PRIORITY}, 1, source_rank FROM doc_all
) SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY priority, similarity_score DESC, place, source_rank) AS INTEGER) AS rank,
  content, source, law_name, category, source_type, similarity_score, CAST(priority AS INTEGER) AS priority
  FROM both_sources WHERE similarity_score >= 0.2 QUALIFY rank <= 10"""
)
def batch_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.batch_hybrid_search(tables.law_articles(spark, sf_dir), tables.user_documents(spark, sf_dir), tables.questions(spark, sf_dir), threshold=0.2)


@query("SELECT count(*) AS total, count(*) FILTER (len(embedding) = 64) AS valid, count(*) FILTER (len(embedding) = 2560) AS full_size FROM embeddings")
def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").agg(
        F.count("*").alias("total"), F.count_if(vector.valid(F.col("embedding"), 64)).alias("valid"), F.count_if(vector.valid(F.col("embedding"), 2560)).alias("full_size")
    )


# --- stores


@query(f"WITH {DOCS_SQL} SELECT user_id, source AS filename, law_name, category, count(*) AS chunk_count, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S') AS uploaded_at FROM docs GROUP BY ALL")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listing(tables.user_documents(spark, sf_dir), "user_id")


def _file(spark: SparkSession, sf_dir: str) -> str:
    """The file of most chunks of USER, the first by name of several."""
    mine = tables.user_documents(spark, sf_dir).where(F.col("user_id") == USER)
    return mine.groupBy(F.col("metadata.source").alias("s")).count().orderBy(F.desc("count"), "s").head()["s"]


_FILE = f"f AS (SELECT source AS s FROM docs WHERE user_id = '{USER}' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"WITH {DOCS_SQL}, {_FILE} SELECT count(*) AS n FROM docs, f WHERE source = s AND user_id = '{USER}'")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_of(tables.user_documents(spark, sf_dir), _file(spark, sf_dir), USER)


@query(f"WITH {DOCS_SQL}, {_FILE} SELECT id, (SELECT count(*) FROM docs, f WHERE source = s AND user_id = '{USER}') AS deleted_chunks FROM docs, f WHERE NOT (source = s AND user_id = '{USER}')")
def delete_returning_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, n = store.delete(tables.user_documents(spark, sf_dir), _file(spark, sf_dir), USER)
    return left.select("id", F.lit(n).cast("long").alias("deleted_chunks"))


@query(f"WITH {DOCS_SQL}, {_FILE} SELECT id, source, user_id, content FROM docs, f WHERE NOT (source = s AND user_id = '{USER}') UNION ALL SELECT -1 - item_id, s, '{USER}', text FROM benchmark, f")
def overwrite_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _file(spark, sf_dir)
    columns = [F.col("id"), F.col("metadata.source").alias("source"), F.col("user_id"), F.col("content")]
    chunks = read(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), F.struct(F.lit(name).alias("source")).alias("metadata"), F.lit(USER).alias("user_id"), F.col("text").alias("content")
    )
    slim = tables.user_documents(spark, sf_dir).select("id", F.struct("metadata.source").alias("metadata"), "user_id", "content")
    return store.overwrite(slim, chunks, name, USER).select(*columns)


@query(f"WITH {LAW_SQL} SELECT law_name, count(*) AS total, count(embedding) AS embedded FROM law GROUP BY 1")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.coverage(tables.law_articles(spark, sf_dir))


@query(f"WITH {LAW_SQL} SELECT id, article_no, left(article_text, 50) AS head, embedding IS NOT NULL AS has_embedding FROM law WHERE law_name = 'src0'")
def article_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = tables.law_articles(spark, sf_dir).where(F.col("law_name") == "src0")
    return law.select("id", "article_no", F.left("article_text", F.lit(50)).alias("head"), F.col("embedding").isNotNull().alias("has_embedding"))


@query(f"WITH {LAW_SQL} SELECT id FROM law WHERE embedding IS NULL AND is_current AND tax_type = '{LABEL}'")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(tables.law_articles(spark, sf_dir), LABEL)


@query(f"WITH {LAW_SQL} SELECT id, law_name, article_no, article_title, article_text FROM law WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def ids_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "labels").where(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return store.with_ids(tables.law_articles(spark, sf_dir), ids).select("id", "law_name", "article_no", "article_title", "article_text")


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9990) AS taken FROM supplier")
def key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9990).select(F.col("c_nationkey").alias("s_nationkey")).distinct().withColumn("taken", F.lit(True))
    return read(spark, sf_dir, "supplier").join(rich, "s_nationkey", "left").select("s_suppkey", F.coalesce("taken", F.lit(False)).alias("taken"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as an upload in doc_id order, keyed by source and text."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("position"), F.col("source").alias("law_name"), F.col("lang").alias("article_no"), F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash")
    )


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that holds the documents labelled bad."""
    bad = read(spark, sf_dir, "labels").where(F.col("quality") == 0).select(F.col("doc_id").alias("position"))
    return _batch(spark, sf_dir).join(bad, "position", "left_semi")


_STATUS = """batch AS (SELECT doc_id AS position, source AS law_name, lang AS article_no, sha256(text) AS content_hash FROM documents),
kept AS (SELECT DISTINCT law_name, article_no, content_hash FROM batch WHERE position IN (SELECT doc_id FROM labels WHERE quality = 0)),
status AS (SELECT b.*, CASE WHEN k.law_name IS NULL AND row_number() OVER (PARTITION BY b.law_name, b.article_no, b.content_hash ORDER BY position) = 1 THEN 'inserted' ELSE 'skipped' END AS status
  FROM batch b LEFT JOIN kept k ON b.law_name = k.law_name AND b.article_no = k.article_no AND b.content_hash = k.content_hash)"""


@query(f"WITH {_STATUS} SELECT position, content_hash, status FROM status")
def upsert_insert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_status(_batch(spark, sf_dir), _kept(spark, sf_dir)).select("position", "content_hash", "status")


@query(f"WITH {_STATUS} SELECT position, 999 + row_number() OVER (ORDER BY position) AS id FROM status WHERE status = 'inserted'")
def upsert_assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.inserted(store.insert_status(_batch(spark, sf_dir), _kept(spark, sf_dir)), 1000).select("position", "id")


@query(f"WITH {_STATUS} SELECT law_name, count(*) AS total, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'skipped') AS skipped FROM status GROUP BY 1")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = store.insert_status(_batch(spark, sf_dir), _kept(spark, sf_dir))
    return status.groupBy("law_name").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "inserted").alias("inserted"), F.count_if(F.col("status") == "skipped").alias("skipped"))


@query("SELECT doc_id AS id, doc_id = max(doc_id) OVER (PARTITION BY source, lang) AS is_current FROM documents")
def supersede_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("law_name"), F.col("lang").alias("article_no"))
    return store.supersede(revisions).select("id", "is_current")


@query(f"WITH {LAW_SQL} SELECT id, CASE WHEN law.embedding IS NOT NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'missing' WHEN c_acctbal > 0 THEN 'embedded' ELSE 'failed' END AS embed_status FROM law LEFT JOIN customer ON c_custkey = id")
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = tables.law_articles(spark, sf_dir)
    unit = F.array_repeat(F.lit(0.125).cast("float"), 64)
    vectors = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, unit).otherwise(F.slice(unit, 1, 3)).alias("embedding"))
    return store.backfill(law, vectors, 64).select("id", "embed_status")


# --- text and rules


@query(
    r"""SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split_regex(
  regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{AD}]', '', 'g'), chr(9), ' '), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '\r\n|[\n\r]'), lambda l: trim(l, ' ' || chr(9) || chr(160) || chr(12288))), chr(10)), ' ' || chr(9) || chr(10) || chr(160) || chr(12288))) AS hash FROM documents"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.normalize_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "clean").select("doc_id", T.content_hash(F.col("clean")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT l_orderkey, l_linenumber, '제' || l_orderkey || '조' || CASE WHEN l_linenumber = 1 THEN '' ELSE '의' || l_linenumber END AS article_no FROM lineitem")
def article_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_linenumber").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.article_no(F.col("l_orderkey").cast("string"), branch).alias("article_no"))


@query(
    f"""WITH {LAW_SQL} SELECT id, sha256('법령명: ' || law_name || chr(10) || '문서유형: ' || law_type || chr(10) || '세목: ' || tax_type || chr(10) || '조문: ' || article_no || chr(10) ||
  '제목: ' || article_title || chr(10) || '내용:' || chr(10) || article_text) AS hash FROM law"""
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.embed_text(*(F.col(c) for c in ("law_name", "law_type", "tax_type", "article_no", "article_title", "article_text")))
    return tables.law_articles(spark, sf_dir).select("id", T.content_hash(made).alias("hash"))


#: Rules over words of the test data; the second can never win over the first.
WORD_RULES = (("ent", "A"), ("enten", "never"), ("thr", "B"), ("ción", "C"), ("eau", "D"), ("the", "E"))
_CASE = lambda value: "CASE " + " ".join(f"WHEN contains({value}, '{k}') THEN '{v}'" for k, v in WORD_RULES)


@query(f"SELECT item_id, {_CASE('lower(text)')} ELSE 'ALL' END AS label FROM benchmark")
def detect_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", rules.detect_label(F.col("text"), rules=WORD_RULES).alias("label"))


@query(f"SELECT p_partkey, {_CASE('p_name')} ELSE p_name END AS tax_type FROM part")
def infer_tax_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", rules.infer_tax_type(F.col("p_name"), WORD_RULES).alias("tax_type"))


_FILE_RULES = ((".com/", "법령"), ("blog.", "never"), (".org/", "시행령")), (("/en/", "english"), ("/fr/", "french"))


@query("SELECT page_id, CASE WHEN contains(url, '.com/') THEN '법령' WHEN contains(url, 'blog.') THEN 'never' WHEN contains(url, '.org/') THEN '시행령' ELSE '기타' END AS category, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/fr/') THEN 'french' ELSE '공통' END AS law_name FROM pages")
def classify_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, law = rules.classify_file(F.col("url"), category_rules=_FILE_RULES[0], law_rules=_FILE_RULES[1])
    return read(spark, sf_dir, "pages").select("page_id", category.alias("category"), law.alias("law_name"))


@query(f"WITH {LAW_SQL} SELECT id, CAST({_LAW_PRIORITY} AS INTEGER) AS priority, {_LAW_SOURCE} AS source_type, CASE WHEN source_url = '' THEN law_name ELSE source_url END AS source FROM law")
def priority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.law_articles(spark, sf_dir).select("id", *(c for c, n in zip(retrieval.law_result(), ("content", "source", "law_name", "category", "source_type", "priority")) if n in ("priority", "source_type", "source")))


# --- chunks

_TOKENS = r"t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM documents)"
_COUNT = "CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 100) / 700.0) AS INTEGER)) END"


@query(f"WITH {_TOKENS}, c AS (SELECT doc_id, w, unnest(range({_COUNT})) AS i FROM t) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 700 AS INTEGER) AS start, CAST(least(800, len(w) - i * 700) AS INTEGER) AS n_tokens, sha256(array_to_string(w[i * 700 + 1 : i * 700 + 800], ' ')) AS hash FROM c")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk(read(spark, sf_dir, "documents"), "text", ["doc_id"])
    return made.select("doc_id", "chunk_index", "start", "n_tokens", T.content_hash(F.col("content")).alias("hash"))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST({_COUNT} AS INTEGER) AS n_chunks FROM t")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = read(spark, sf_dir, "documents").select("doc_id", F.size(chunking.words(F.col("text"))).alias("n_tokens"))
    return counted.withColumn("n_chunks", chunking.window_count(F.col("n_tokens"), 800, 100))


# --- discovery

_RESULTS = "SELECT p_size AS keyword_rank, p_partkey AS position, substr(p_name, 1, 2) AS mst, p_type AS ministry FROM part"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_size").alias("keyword_rank"), F.col("p_partkey").alias("position"), F.substring("p_name", 1, 2).alias("mst"), F.col("p_type").alias("ministry"))


@query(f"WITH r AS ({_RESULTS}) SELECT * FROM r WHERE contains(ministry, 'E') OR contains(ministry, 'O')")
def ministry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.of_ministries(_results(spark, sf_dir), ("E", "O"))


@query(f"WITH r AS ({_RESULTS}) SELECT mst, keyword_rank, position FROM r WHERE contains(ministry, 'E') OR contains(ministry, 'O') QUALIFY row_number() OVER (PARTITION BY mst ORDER BY keyword_rank, position) = 1")
def discover_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover(_results(spark, sf_dir), ("E", "O")).select("mst", "keyword_rank", "position")


# --- conversations

_LAST = """last AS (SELECT conv_id AS session_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 6)"""


@query(f"WITH {_LAST} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS place, role, text AS content FROM last")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = conversation.last_messages(tables.chat_logs(spark, sf_dir))
    return kept.select("session_id", "place", "message.role", "message.content")


@query(f"WITH {_LAST} SELECT session_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM last GROUP BY 1")
def history_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversation.transcript(conversation.last_messages(tables.chat_logs(spark, sf_dir)))
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return made.select("session_id", F.size("history").cast("long").alias("n"), F.array_join(lines, "\n").alias("transcript"))


@query(
    f"""WITH {_LAST}, h AS (SELECT session_id, count(*) AS n, string_agg(role || text, '' ORDER BY turn) AS body FROM last GROUP BY 1)
SELECT session_id, n + 2 AS n, sha256('systemANSWER' || body || 'user[사용자 질문]' || chr(10) || 'q' || session_id || chr(10) || chr(10) || '[내부 DB 검색 결과]' || chr(10) || 'a' || chr(10) || chr(10) || '[웹 검색 결과]' || chr(10) || 'w') AS hash FROM h"""
)
def final_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversation.transcript(conversation.last_messages(tables.chat_logs(spark, sf_dir)))
    messages = conversation.final_messages("ANSWER", F.col("history"), F.concat(F.lit("q"), F.col("session_id").cast("string")), F.lit("a"), F.lit("w"))
    return made.select("session_id", messages.alias("m")).select(
        "session_id", F.size("m").cast("long").alias("n"), T.content_hash(F.array_join(F.transform("m", lambda x: F.concat(x["role"], x["content"])), "")).alias("hash")
    )


@query("SELECT event_id, CASE WHEN value > 50 THEN event_type END AS gap_found, value > 50 AS wanted FROM events")
def gap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of events: a thought, then JSON if the value is over 50, else something that is none."""
    json = F.to_json(F.struct(F.col("event_type").alias("gap_found"), F.array(F.col("event_type")).alias("search_queries"), F.lit(True).alias("search_required")))
    replies = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("<think>x</think> "), F.when(F.col("value") > 50, json).otherwise("none")).alias("reply"))
    gap = replies.select("event_id", conversation.parse_gap(F.col("reply")).alias("gap"))
    return gap.select("event_id", F.col("gap.gap_found").alias("gap_found"), conversation.wants_search(F.col("gap")).alias("wanted"))


@query(
    """WITH r AS (SELECT l_orderkey AS key, CAST(l_linenumber - 1 AS INTEGER) AS query_idx, CAST(l_quantity AS INTEGER) % 5 AS rank, l_returnflag || l_suppkey AS url, repeat(l_linestatus, 600) AS content FROM lineitem)
SELECT key, string_agg('[출처: ' || url || ']' || chr(10) || left(content, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY query_idx, rank, '[출처: ' || url || ']' || chr(10) || left(content, 500)) AS web FROM r WHERE query_idx < 3 AND rank < 3 GROUP BY 1"""
)
def web_results_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).alias("query_idx"), (F.col("l_quantity").cast("int") % 5).alias("rank"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("url"), F.repeat("l_linestatus", F.lit(600)).alias("content")
    )
    return conversation.web_text(results, "key")


# --- streams


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations GROUP BY 1")
def think_filter_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of chunks; two of three have a thought whose marks are cut at changing places; the answers are the texts."""
    turns = read(spark, sf_dir, "conversations")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    whole = F.when(first & (F.col("conv_id") % 3 > 0), F.concat(F.lit("<think>hidden</think>"), F.col("text"))).otherwise(F.col("text"))
    at = (F.col("conv_id") % 20 + 1).cast("int")
    pieces = F.array(F.substr(whole, F.lit(1), at), F.substr(whole, at + 1, F.lit(4)), F.substr(whole, at + 5))
    cut = turns.select("conv_id", "turn", pieces.alias("pieces")).select("conv_id", "turn", F.posexplode("pieces").alias("piece", "content"))
    line = F.to_json(F.struct(F.struct("content").alias("message")))
    lines = cut.select(F.col("conv_id").cast("string").alias("stream_id"), (F.col("turn") * 3 + F.col("piece")).alias("seq"), line.alias("line"))
    return think_filter.answers(think_filter.filter_batch(lines))


@query("SELECT conv_id, turn, 'data: {\"chunk\":\"' || replace(text, chr(10), '\\n') || '\"}' || chr(10) || chr(10) AS event FROM conversations")
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", think_filter.sse(F.col("text")).alias("event"))


from statuta.plans import composed, indexes, streams  # noqa: E402,F401  register the queries of composed operators, of streams and of indexes
