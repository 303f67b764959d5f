"""Questions answered as a whole: label, search, first answer, gaps, web, final answer, saved turn."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators import conversation, retrieval, rules
from statuta.options import DEFAULTS
from statuta.shared import cut
from statuta.sources import providers

MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Prompts:
    """System messages of the three calls; the second has to ask for JSON of the fields in schemas.GAP."""

    answer: str = "세법 질문에 검색된 자료만으로 답한다. 법률, 시행령, 시행규칙, 실무자료 순으로 따르고 조문 번호를 밝힌다. 자료에 없으면 없다고 쓴다."
    gap: str = '1차 답변에서 근거가 빠진 곳을 찾아 검색어를 만든다. JSON으로만 답한다: {"gap_found": 설명, "search_queries": [검색어], "search_required": true 또는 false}'
    final: str = "내부 자료와 웹 자료를 합쳐 최종 답을 쓴다. 조문이 웹보다 앞서고, 각 근거의 출처를 밝힌다."


def ask(rows: DataFrame, messages: Column, key: str, chat: providers.Chat) -> DataFrame:
    """(key, reply): the model's replies to messages as JSON, written once so that no later plan calls again."""
    return cut(providers.reply(rows.select(key, F.to_json(messages).alias("prompt")), "prompt", key, chat), "reply")


def labelled(questions: DataFrame, label_chat: providers.Chat | None = None, label_rules: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """questions with `label`; only those that no rule knows go to the model, if one is given."""
    label_rules = list(rules.question_rules() if label_rules is None else label_rules)
    if label_chat is None:
        return questions.withColumn("label", rules.detect_label(F.col("text"), rules=label_rules))
    unknown = questions.where(rules.first_match(F.lower("text"), label_rules).isNull())
    replies = cut(providers.reply(unknown, "text", "question_id", label_chat), "label")
    return questions.join(replies, "question_id", "left").withColumn("label", rules.detect_label(F.col("text"), F.col("reply"), label_rules)).drop("reply")


def answers(
    questions: DataFrame,
    law: DataFrame,
    documents: DataFrame,
    logs: DataFrame,
    chat: providers.Chat,
    gap_chat: providers.Chat | None = None,
    search: providers.Search | None = None,
    label_chat: providers.Chat | None = None,
    label_rules: Iterable[tuple[str, str]] | None = None,
    prompts: Prompts = Prompts(),
    k: int = DEFAULTS.top_k,
    threshold: float = DEFAULTS.similarity_threshold,
    turns: int = DEFAULTS.history_turns,
) -> DataFrame:
    """(question_id, session_id, user_id, question, label, rag_answer, web, answer) of questions (question_id, session_id, user_id, text, embedding).

    A question's label and user bound what is searched. Questions of one
    session in one table all see the logs as they were before. Without `search`
    the web is skipped; a failed web query gives nothing; a failed model call
    leaves the question without an answer (null), and others go on.
    """
    asked = cut(labelled(questions.select("question_id", "session_id", "user_id", "text", "embedding"), label_chat, label_rules), "asked")
    found = retrieval.contexts(retrieval.batch_hybrid_search(law, documents, asked, k, threshold, scoped=True), "question_id")
    past = logs.join(asked.select("session_id").distinct(), "session_id", "left_semi")
    history = conversation.transcript(conversation.last_messages(past, turns))
    ready = asked.drop("embedding").join(found, "question_id", "left").join(history, "session_id", "left")
    ready = ready.withColumn("context", F.coalesce("context", F.lit(retrieval.NOT_FOUND))).withColumn("history", F.coalesce("history", F.array().cast(MESSAGES)))
    ready = cut(ready, "ready")
    first = ask(ready, conversation.answer_messages(prompts.answer, F.col("history"), F.col("context"), F.col("text")), "question_id", chat)
    ready = ready.join(first.withColumnRenamed("reply", "rag_answer"), "question_id", "left")
    answered = F.col("rag_answer").isNotNull()
    if search is None:
        ready = ready.withColumn("web", F.when(answered, conversation.WEB_SKIPPED))
    else:
        gap = ask(ready.where(answered), conversation.gap_messages(prompts.gap, F.col("text"), F.col("rag_answer")), "question_id", gap_chat or chat)
        gap = gap.withColumn("gap", conversation.parse_gap(F.col("reply"))).withColumn("wanted", conversation.wants_search(F.col("gap")))
        results = cut(providers.web_search(gap.where("wanted").select("question_id", "gap.search_queries"), "question_id", "search_queries", search), "web")
        web = gap.where(F.col("reply").isNotNull()).join(conversation.web_text(results, "question_id"), "question_id", "left")
        ready = ready.join(web.select("question_id", conversation.chosen_web(F.col("wanted"), F.col("web")).alias("web")), "question_id", "left")
    last = ask(ready.where(F.col("web").isNotNull()), conversation.final_messages(prompts.final, F.col("history"), F.col("text"), F.col("rag_answer"), F.col("web")), "question_id", chat)
    ready = ready.join(last.withColumnRenamed("reply", "answer"), "question_id", "left")
    return ready.select("question_id", "session_id", "user_id", F.col("text").alias("question"), "label", "rag_answer", "web", "answer")


def saved(answered: DataFrame) -> DataFrame:
    """Rows for the logs: question and answer of each answered question."""
    return conversation.turn_rows(answered.where(F.col("answer").isNotNull()))
