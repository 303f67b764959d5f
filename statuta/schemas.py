"""Schemas of the tables and records, as DDL strings."""

LAW_SUMMARY = "mst string, law_name string, law_type string, promulgation_date string, ministry string"
ARTICLE = "law_name string, law_type string, article_no string, article_title string, article_text string, effective_date string, amendment_date string"
LAW_ARTICLES = f"id long, {ARTICLE}, tax_type string, source_url string, content_hash string, embedding array<float>, is_current boolean, created_at timestamp, updated_at timestamp"
METADATA = "struct<source:string,law_name:string,category:string,uploader:string,chunk_index:int>"
DOCUMENTS = f"id long, content string, embedding array<float>, metadata {METADATA}, user_id string, created_at timestamp"
CHAT_LOGS = "id long, session_id string, message struct<role:string,content:string>, created_at timestamp"
RESULT = "content string, source string, law_name string, category string, source_type string, similarity_score double, priority int"
GAP = "gap_found string, search_queries array<string>, search_required boolean"
USERS = "id string, email string"
