"""Queries of composed operators: sources' replies, ingestion, uploads, chats and events, over fixtures made of the tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators import chat, conversation, discovery, ingestion, retrieval, rules, store, upload
from statuta.plans.digests import DIGEST_SQL, digest_vectors, shown
from statuta.plans.registry import _CASE, _CAT_PRIORITY, _CAT_SOURCE, _LAST, _LAW_CONTENT, _LAW_PRIORITY, _LAW_SOURCE, USER, WORD_RULES, query
from statuta.sources import law_xml, providers, tables
from statuta.sources.tables import DOCS_SQL, LAW_SQL, read
from statuta.streaming import think_filter

_NL = "chr(10)"
_SEPARATOR = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _tag(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.lit(value) if isinstance(value, str) else value, F.lit(f"</{name}>"))


def _string(name: str) -> Column:
    return F.col(name).cast("string")


# --- replies of the law service


@query(
    """SELECT doc_id AS mst, 0 AS position, CASE WHEN doc_id % 4 = 0 OR coalesce(source, '') = '' THEN 'hint' ELSE source END AS law_name, '법률' AS law_type,
  '제' || doc_id || '조' || CASE WHEN n_chars % 2 = 0 THEN '' ELSE '의' || n_chars % 7 END AS article_no, coalesce(lang, '') AS article_title,
  'body ' || n_chars || CASE WHEN n_chars % 3 > 0 THEN chr(10) || 'p1' ELSE '' END || CASE WHEN n_chars % 3 > 1 THEN chr(10) || 'p2' ELSE '' END AS article_text,
  '20260101' AS effective_date, '' AS amendment_date FROM documents WHERE n_chars % 5 <> 0 AND n_chars % 11 <> 0"""
)
def statute_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statute for each document: an article, sometimes deleted, and one without text; some payloads are malformed."""
    n, nothing = F.col("n_chars"), F.lit("")
    paragraph = lambda i: F.when(n % 3 >= i, _tag("항", _tag("항내용", f" p{i} "))).otherwise(nothing)
    unit = _tag(
        "조문단위",
        F.concat(
            _tag("조문번호", _string("doc_id")),
            _tag("조문가지번호", F.when(n % 2 == 0, nothing).otherwise((n % 7).cast("string"))),
            _tag("조문여부", F.when(n % 5 == 0, "삭제").otherwise(nothing)),
            _tag("조문제목", F.coalesce("lang", nothing)),
            _tag("조문내용", F.concat(F.lit("body  "), n.cast("string"))),
            paragraph(1),
            paragraph(2),
        ),
    )
    name = F.when(F.col("doc_id") % 4 == 0, nothing).otherwise(_tag("법령명_한글", F.coalesce("source", nothing)))
    info = _tag("기본정보", F.concat(name, _tag("법종류", "법률"), _tag("시행일자", "20260101")))
    xml = F.concat(_tag("법령", F.concat(info, _tag("조문", F.concat(unit, _tag("조문단위", _tag("조문번호", "9")))))), F.when(n % 11 == 0, "<").otherwise(nothing))
    payloads = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("mst"), F.lit("hint").alias("hint"), xml.alias("raw_xml"))
    return law_xml.parse_articles(payloads, name_hint="hint")


def _lines(spark: SparkSession, sf_dir: str, made: Callable[[Column], Column]) -> DataFrame:
    """(o_orderkey, o_orderstatus, inner): what is made of an order's few lines, in order, as one text; made after the shuffle."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("l"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    return orders.select("o_orderkey", "o_orderstatus", F.coalesce(F.array_join(F.transform("l", made), ""), F.lit("")).alias("inner"))


_REPLIES = """r AS (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS INTEGER) AS position,
  CAST(l_partkey AS VARCHAR) AS mst, l_returnflag || l_linestatus AS law_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0)"""


def _search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search reply for each order, its lines as laws; some are malformed."""
    law = lambda r: _tag("law", F.concat(_tag("법령일련번호", r["l_partkey"].cast("string")), _tag("법령명한글", F.concat(r["l_returnflag"], r["l_linestatus"]))))
    reply = F.when(F.col("o_orderkey") % 13 == 0, "<broken").otherwise(_tag("LawSearch", F.concat(_tag("totalCnt", "7"), F.col("inner"))))
    return law_xml.search_rows(_lines(spark, sf_dir, law).withColumn("xml", reply), "o_orderkey", "xml")


@query(f"WITH {_REPLIES} SELECT o_orderkey, position, mst, law_name, FALSE AS failed FROM r UNION ALL SELECT o_orderkey, 0, NULL, NULL, TRUE FROM orders WHERE o_orderkey % 13 = 0")
def search_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search_rows(spark, sf_dir).select("o_orderkey", "position", "mst", "law_name", F.col("error").isNotNull().alias("failed"))


@query(f"WITH {_REPLIES} SELECT o_orderkey, mst, position FROM r WHERE law_name = 'RF' QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY position) = 1")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of exactly one name in each reply."""
    named = _search_rows(spark, sf_dir).where(F.col("law_name") == "RF")
    return discovery.first_of_each(named, "o_orderkey", "position").select("o_orderkey", "mst", "position")


# --- ingestion

_INGESTED = """line AS (SELECT o_orderkey, o_orderstatus, l_linenumber, l_linenumber % 3 AS no, l_returnflag || l_linestatus AS body FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
stored AS (SELECT DISTINCT o_orderkey, no, body FROM line WHERE l_linenumber = 1 AND o_orderkey % 2 = 0),
counted AS (SELECT o_orderkey, count(*) AS total, count(DISTINCT (no, body)) FILTER ((o_orderkey, no, body) NOT IN (SELECT (o_orderkey, no, body) FROM stored)) AS new FROM line GROUP BY 1),
report AS (SELECT o_orderkey AS target_idx, 'law' || o_orderkey AS law_name, CASE WHEN o_orderstatus = 'P' THEN 'no law of exactly this name' WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS error,
  CASE WHEN error IS NULL THEN coalesce(total, 0) END AS total_articles, CASE WHEN error IS NULL THEN coalesce(new, 0) END AS inserted_count,
  CASE WHEN error IS NULL THEN coalesce(total - new, 0) END AS skipped_count, CAST(CASE WHEN error IS NULL THEN 0 END AS BIGINT) AS failed_count,
  CASE WHEN error IS NULL THEN coalesce(new, 0) END AS embedded_count, CAST(CASE WHEN error IS NULL THEN 0 END AS BIGINT) AS embed_failed_count FROM orders LEFT JOIN counted USING (o_orderkey))"""


def _ingested(spark: SparkSession, sf_dir: str) -> ingestion.Ingested:
    """Each order as a wanted law whose articles are its lines; some have no hit, some no detail, some articles are stored."""
    no, body = (F.col("l_linenumber") % 3).cast("string"), F.concat("l_returnflag", "l_linestatus")
    unit = lambda r: _tag("조문단위", F.concat(_tag("조문번호", (r["l_linenumber"] % 3).cast("string")), _tag("조문내용", F.concat(r["l_returnflag"], r["l_linestatus"]))))
    orders, units = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _lines(spark, sf_dir, unit)
    key, name = _string("o_orderkey"), F.concat(F.lit("law"), _string("o_orderkey"))
    wanted = orders.select(F.col("o_orderkey").alias("target_idx"), name.alias("law_name"), F.col("o_orderstatus").alias("tax_type"))
    hit = F.when(F.col("o_orderstatus") == "P", F.concat(name, F.lit("x"))).otherwise(name)
    results = orders.select(F.explode(F.array(*(F.struct(F.lit(i).alias("position"), hit.alias("law_name"), F.concat(F.lit(m), key).alias("mst"), F.lit("법률").alias("law_type")) for i, m in enumerate("mn")))).alias("r")).select("r.*")
    failed = F.col("o_orderkey") % 5 == 0
    details = units.select(F.concat(F.lit("m"), key).alias("mst"), F.when(~failed, _tag("법령", _tag("조문", F.col("inner")))).alias("raw_xml"), F.when(failed, "timeout").alias("error"))
    stored = read(spark, sf_dir, "lineitem").where((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 2 == 0))
    stored = stored.select(F.concat(F.lit("law"), _string("l_orderkey")).alias("law_name"), T.article_no(no, F.lit("")).alias("article_no"), T.content_hash(body).alias("content_hash"))
    return ingestion.ingest(wanted, results, details, stored, 1000, providers.HashEmbedder(8), 8)


@query(f"WITH {_INGESTED} SELECT * FROM report")
def ingest_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).report.drop("mst")


@query(
    f"""WITH {_INGESTED} SELECT count(*) AS laws, count(*) FILTER (error IS NULL) AS success, count(error) AS errors,
  {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ingestion.COUNTS)} FROM report"""
)
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.summary(_ingested(spark, sf_dir).report)


@query(f"SELECT item_id AS id, 8 AS dimensions, TRUE AS fits, {DIGEST_SQL.format('text')} AS vector FROM benchmark")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    made = providers.embed(rows, "text", "id", digest_vectors)
    return made.select("id", F.size("embedding").alias("dimensions"), F.col("error").isNull().alias("fits"), shown().alias("vector"))


# --- uploads

_FILES = r"""f AS (SELECT page_id AS file_id, CASE WHEN page_id % 4 = 0 THEN 'page' || page_id || '.txt' ELSE 'page' || page_id // 2 || '.PDF' END AS filename, length(html) AS n,
  CASE WHEN page_id % 9 = 0 THEN chr(10) || ' ' || chr(160) || chr(12288) || chr(10) ELSE html END AS text FROM pages),
w AS (SELECT *, CASE WHEN page_id4 THEN 400 WHEN n > 2000 THEN 413 WHEN regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g') = '' THEN 422 END AS reject_code,
  len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '')) AS words FROM (SELECT *, filename LIKE '%.txt' AS page_id4 FROM f)),
report AS (SELECT file_id, filename, CAST(reject_code AS INTEGER) AS reject_code,
  CASE WHEN contains(filename, 'page1') THEN 'A' WHEN file_id % 3 < 2 THEN 'c' ELSE '기타' END AS category,
  CASE WHEN contains(filename, '9') THEN 'L' WHEN file_id % 3 = 0 THEN 'l' ELSE '공통' END AS law_name,
  CASE WHEN reject_code IS NOT NULL THEN 0 ELSE greatest(1, CAST(ceil((words - 10) / 40.0) AS BIGINT)) END AS chunks_stored,
  CASE WHEN reject_code IS NULL THEN 'ok' ELSE 'rejected' END AS status FROM w)"""


def _uploaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as uploads of one user: no PDF, too large, nothing but white space, of one name in pairs; the store has files of such names."""
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("page"), i.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("page"), F.floor(i / 2).cast("string"), F.lit(".PDF")))
    reply = F.when(i % 3 == 0, '{"category": "c", "law_name": "l"}').when(i % 3 == 1, '{"category": "c"}').otherwise("none")
    files = read(spark, sf_dir, "pages").select(i.alias("file_id"), path.alias("path"), F.length("html").alias("length"), F.when(i % 9 == 0, "\n \u00a0\u3000\n").otherwise(F.col("html")).alias("text"), F.lit(USER).alias("user_id"), F.lit("u").alias("uploader"), reply.alias("reply"))
    named = F.col("metadata").withField("source", F.concat(F.lit("page"), _string("id"), F.lit(".PDF")))
    stored = tables.user_documents(spark, sf_dir).withColumn("metadata", named)
    return upload.upload(files, stored, providers.HashEmbedder(8), 2000, (("page1", "A"),), (("9", "L"),), 50, 10)


@query(f"WITH {_FILES} SELECT * FROM report")
def upload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploaded(spark, sf_dir)[1]


@query(
    f"""WITH {DOCS_SQL}, {_FILES}, latest AS (SELECT filename, max(file_id) AS file_id FROM report WHERE status = 'ok' GROUP BY 1),
chunk AS (SELECT report.filename, category, unnest(range(chunks_stored)) AS i FROM report JOIN latest USING (file_id)),
every AS (SELECT 'page' || id || '.PDF' AS source, user_id, coalesce(category, '') AS category, 0 AS i FROM docs WHERE NOT (user_id = '{USER}' AND 'page' || id || '.PDF' IN (SELECT filename FROM latest))
  UNION ALL SELECT filename, '{USER}', category, i FROM chunk)
SELECT source, user_id, category, count(*) AS n, CAST(sum(i) AS BIGINT) AS indexes FROM every GROUP BY ALL"""
)
def upload_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _uploaded(spark, sf_dir)[0].select("metadata.source", "user_id", F.coalesce("metadata.category", F.lit("")).alias("category"), F.col("metadata.chunk_index").alias("i"))
    return rows.groupBy("source", "user_id", "category").agg(F.count("*").alias("n"), F.sum("i").alias("indexes"))


@query(f"""WITH {DOCS_SQL}, l AS (SELECT user_id, source AS filename, law_name, category, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S') AS uploaded_at FROM docs GROUP BY ALL)
SELECT user_id, filename, law_name, category, CAST(row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, filename NULLS FIRST, law_name NULLS FIRST, category NULLS FIRST) AS INTEGER) AS place FROM l""")
def file_listing_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = store.listing(tables.user_documents(spark, sf_dir), "user_id")
    return store.newest_first(listed, "user_id").select("user_id", "filename", "law_name", "category", "place")


@query("SELECT doc_id, replace(left(text, 80), chr(10), ' ') || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS preview FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


# --- chats


def digest_chat(prompts: list[str]) -> list[str]:
    """A model without a network: replies with the hash of its messages."""
    return [hashlib.sha256("\n".join(m["role"] + m.get("content", "") for m in json.loads(p)).encode()).hexdigest() for p in prompts]


def digest_gap(prompts: list[str]) -> list[str]:
    """Replies with a thought and JSON that asks for the web if the hash begins with less than 8."""
    return ["<think>x</think>\n" + json.dumps({"gap_found": h, "search_queries": [h[:4], "fail", h[4:8], h[8:12]], "search_required": h < "8"}) for h in digest_chat(prompts)]


def digest_search(text: str, results: int, domains: tuple[str, ...]) -> list[dict]:
    """A search without a network: a long result, and one without an address; one query fails."""
    if text == "fail":
        raise OSError(text)
    return [{"url": f"https://{domains[0]}/{text}", "content": text * 200}, {"content": text}][:results]


LABELS = (("ent", "en"), ("ción", "es"), ("der", "de"))
_LABEL = "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in LABELS) + " ELSE 'ALL' END"
_RANKED = "list_cosine_similarity(embedding, v) AS sim, row_number() OVER (PARTITION BY question_id ORDER BY round(list_cosine_similarity(embedding, v), 9) DESC, id) AS source_rank"
_WEB = " || chr(10) || chr(10) || '---' || chr(10) || chr(10) || ".join(
    f"'[출처: https://nts.go.kr/' || {q} || ']' || chr(10) || left(repeat({q}, 200), 500) || {_SEPARATOR} || '[출처: ?]' || chr(10) || {q}" for q in ("left(d, 4)", "substr(d, 5, 4)")
)


@query(
    f"""WITH {LAW_SQL}, {DOCS_SQL}, {_LAST},
qs AS (SELECT item_id AS question_id, text AS question, {_LABEL} AS label, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
law_all AS (SELECT question_id, law.*, {_RANKED} FROM law, qs WHERE is_current AND embedding IS NOT NULL AND (label = 'ALL' OR tax_type = label) QUALIFY source_rank <= 10),
doc_all AS (SELECT question_id, docs.*, {_RANKED} FROM docs, qs WHERE embedding IS NOT NULL AND user_id = '{USER}' AND (label = 'ALL' OR law_name = label) QUALIFY source_rank <= 10),
both_sources AS (
  SELECT question_id, {_LAW_CONTENT} AS content, CASE WHEN source_url = '' THEN law_name ELSE source_url END AS source, law_name, law_type AS category,
    {_LAW_SOURCE} AS source_type, round(sim, 4) AS similarity_score, {_LAW_PRIORITY} AS priority, 0 AS place, source_rank FROM law_all
  UNION ALL SELECT question_id, content, source, law_name, coalesce(category, '기타'), {_CAT_SOURCE}, round(sim, 4), {_CAT_PRIORITY}, 1, source_rank FROM doc_all),
merged AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY priority, similarity_score DESC, place, source_rank) AS rank FROM both_sources WHERE similarity_score >= 0.1 QUALIFY rank <= 10),
ctx AS (SELECT question_id, string_agg('[출처: ' || source || ' | ' || law_name || ' | 📌 ' || category || ' (' || source_type || ')]' || {_NL} || content, {_SEPARATOR} ORDER BY rank) AS context FROM merged GROUP BY 1),
h AS (SELECT session_id, string_agg(role || coalesce(text, ''), {_NL} ORDER BY turn) || {_NL} AS body FROM last GROUP BY 1),
a AS (SELECT qs.question_id, label, question, coalesce(body, '') AS body, sha256('systemA' || {_NL} || coalesce(body, '') || 'user[검색된 세무 법령 자료]' || {_NL} || coalesce(context, '{retrieval.NOT_FOUND}') ||
  {_NL} || {_NL} || '[사용자 질문]' || {_NL} || question) AS rag_answer FROM qs LEFT JOIN ctx USING (question_id) LEFT JOIN h ON session_id = qs.question_id),
g AS (SELECT *, sha256('systemG' || {_NL} || 'user[사용자 질문]' || {_NL} || question || {_NL} || {_NL} || '[1차 답변]' || {_NL} || rag_answer) AS d FROM a),
w AS (SELECT *, CASE WHEN d < '8' THEN {_WEB} ELSE '웹 검색 생략' END AS web FROM g)
SELECT question_id, label, rag_answer, web, sha256('systemF' || {_NL} || body || 'user[사용자 질문]' || {_NL} || question || {_NL} || {_NL} || '[내부 DB 검색 결과]' || {_NL} || rag_answer ||
  {_NL} || {_NL} || '[웹 검색 결과]' || {_NL} || web) AS answer FROM w"""
)
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items asked in the conversations of their numbers."""
    asked = tables.questions(spark, sf_dir).select("question_id", F.col("question_id").alias("session_id"), F.lit(USER).alias("user_id"), "text", "embedding")
    made = chat.answers(
        asked, tables.law_articles(spark, sf_dir), tables.user_documents(spark, sf_dir), tables.chat_logs(spark, sf_dir),
        digest_chat, digest_gap, digest_search, label_rules=LABELS, prompts=chat.Prompts("A", "G", "F"), threshold=0.1,
    )
    return made.select("question_id", "label", "rag_answer", "web", "answer")


@query("SELECT item_id AS session_id, 0 AS seq, 'user' AS role, text AS content FROM benchmark UNION ALL SELECT item_id, 1, 'assistant', 'a' || item_id FROM benchmark")
def saved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id"), F.col("text").alias("question"), F.concat(F.lit("a"), _string("item_id")).alias("answer"))
    return chat.saved(turns).select("session_id", "seq", "message.role", "message.content")


@query(f"SELECT item_id, coalesce({_CASE('lower(text)')} END, CASE WHEN item_id % 3 = 0 THEN 'A' END, 'ALL') AS label FROM benchmark")
def detect_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels where a model replies a known label, an unknown one, or nothing."""
    reply = F.when(F.col("item_id") % 3 == 0, " A ").when(F.col("item_id") % 3 == 1, "zzz")
    return read(spark, sf_dir, "benchmark").select("item_id", rules.detect_label(F.col("text"), reply, WORD_RULES).alias("label"))


# --- events


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(_string("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("chunk"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn AS seq, 'data: {"chunk":"' || replace(text, chr(10), '\\n') || '"}' || chr(10) || chr(10) AS event FROM conversations
UNION ALL SELECT CAST(conv_id AS VARCHAR), max(turn) + 1, 'data: [DONE]' || chr(10) || chr(10) FROM conversations GROUP BY 1"""
)
def sse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return think_filter.sse_rows(_chunks(spark, sf_dir))


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 2 - 2 AS INTEGER) AS place, text AS chunk FROM conversations")
def sse_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of a stream's events with noise between them, and more behind their end."""
    events = think_filter.sse_rows(_chunks(spark, sf_dir)).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("e"))
    body = F.concat(F.array_join(F.transform("e", lambda x: x["event"]), "noise\n\n"), F.lit('data: {"chunk":"late"}\n\n'))
    return think_filter.parse_sse(events.select("stream_id", body.alias("body")), "stream_id", "body")
