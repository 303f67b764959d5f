"""Histories, prompts, gap analysis and web results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.options import DEFAULTS
from statuta.schemas import GAP

# Texts of prompts that are read back, and markers of skipped and empty web searches.
QUESTION, CONTEXT, FIRST_ANSWER = "[사용자 질문]\n", "[검색된 세무 법령 자료]\n", "[1차 답변]\n"
INTERNAL, WEB = "[내부 DB 검색 결과]\n", "[웹 검색 결과]\n"
WEB_SKIPPED, WEB_NONE, SOURCE = "웹 검색 생략", "웹 검색 결과 없음", "[출처: "
SEPARATOR = "\n\n---\n\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def last_messages(logs: DataFrame, turns: int = DEFAULTS.history_turns, session: str = "session_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The last 2 * turns messages of each session, with `place` from the oldest on."""
    newest = Window.partitionBy(session).orderBy(*(F.desc(c) for c in order))
    kept = logs.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= 2 * turns)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("back")))).drop("back")


def transcript(messages: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, history): an array of messages in order."""
    return messages.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("place", "message"))).alias("h")).select(session, F.transform("h", lambda x: x["message"]).alias("history"))


def answer_messages(system: str, history: Column, context: Column, question: Column) -> Column:
    user = F.concat(F.lit(CONTEXT), context, F.lit("\n\n" + QUESTION), question)
    return F.concat(F.array(message("system", F.lit(system))), history, F.array(message("user", user)))


def gap_messages(system: str, question: Column, answer: Column) -> Column:
    user = F.concat(F.lit(QUESTION), question, F.lit("\n\n" + FIRST_ANSWER), answer)
    return F.array(message("system", F.lit(system)), message("user", user))


def final_messages(system: str, history: Column, question: Column, answer: Column, web: Column) -> Column:
    user = F.concat(F.lit(QUESTION), question, F.lit("\n\n" + INTERNAL), answer, F.lit("\n\n" + WEB), web)
    return F.concat(F.array(message("system", F.lit(system))), history, F.array(message("user", user)))


def after_think(reply: Column) -> Column:
    """What follows the last </think>, trimmed."""
    return F.trim(F.element_at(F.split(reply, "</think>", -1), -1))


def parse_gap(reply: Column) -> Column:
    """struct<gap_found, search_queries, search_required>; null for blank and invalid replies."""
    clean = after_think(reply)
    return F.when(clean != "", F.from_json(clean, GAP, {"mode": "PERMISSIVE"}))


def wants_search(gap: Column, has_key: bool = True) -> Column:
    return F.lit(has_key) & F.coalesce(gap["search_required"] & (F.size(gap["search_queries"]) > 0), F.lit(False))


def web_text(results: DataFrame, key: str, queries: int = DEFAULTS.web_queries, per_query: int = DEFAULTS.web_results, chars: int = DEFAULTS.web_chars) -> DataFrame:
    """(key, web): the first results of the first queries as one text; results are (key, query_idx, rank, url, content)."""
    kept = results.where((F.col("query_idx") < queries) & (F.col("rank") < per_query))
    entry = F.concat(F.lit(SOURCE), F.coalesce("url", F.lit("?")), F.lit("]\n"), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    made = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("query_idx", "rank", entry.alias("entry")))).alias("e"))
    return made.select(key, F.array_join(F.transform("e", lambda x: x["entry"]), SEPARATOR).alias("web"))


def chosen_web(wanted: Column, web: Column) -> Column:
    return F.when(wanted, F.coalesce(web, F.lit(WEB_NONE))).otherwise(WEB_SKIPPED)


def turn_rows(turns: DataFrame) -> DataFrame:
    """(session_id, seq, message): a user and an assistant row of each (session_id, question, answer)."""
    rows = turns.select("session_id", F.posexplode(F.array(message("user", F.col("question")), message("assistant", F.col("answer")))).alias("seq", "message"))
    return rows
