r"""Operator 4: chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as `### Role: text</turn>` and a line feed. Every assistant
turn becomes an example of its own: the context is all that stands before its
text, the target is its text and the end mark, and only the text (the first
loss_chars characters of the target) is trainable. Turns after the last
assistant turn make one last example without a trainable text, so that a
conversation can be read back from its examples.

Roles and texts are escaped so that none holds a mark: `\` is doubled, and
`\s` goes into each `###` and `</turn>` and after each colon of a role.
Reading back undoes each. The roles in ROLES are written with a capital, all
others after `=`.

Defined cases: a null text or role counts as empty; rows without conv_id form
one conversation of null id; repeated rows and turns stay, ordered by turn
(nulls first), role and text; a conversation without an assistant turn has one
example and nothing trainable; an empty table has no conversations; other
columns are not read. A conversation is the unit of work, since its digests
are over its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table

END = "</turn>\n"
ROLES = ("system", "user", "assistant", "tool")
#: What conversation -7 says, in a user and an assistant row.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, "#(?=##)", r"#\\s"), "<(?=/turn>)", r"<\\s")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:s|(\\))", "$1")


def header(role: Column) -> Column:
    named = F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit(":\\s"))))
    return F.concat(F.lit("### "), named, F.lit(": "))


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, context, target, loss_chars): one row for each assistant turn, and one for the turns after the last."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    written = turns.select(
        "conv_id",
        F.struct("turn", role.alias("role"), text.alias("text")).alias("key"),
        header(role).alias("head"),
        escape(text).alias("body"),
        (role == "assistant").alias("reply"),
    )
    grouped = written.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("key", "head", "body", "reply"))).alias("turns"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    ends = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["reply"].alias("reply"))),
        lambda e: e["reply"] | (e["i"] == F.size("turns") - 1),
    )
    exploded = grouped.select("conv_id", "turns", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end.i") + 1)
    before = F.array_join(F.transform(F.slice("turns", 1, F.col("end.i")), whole), "")
    return exploded.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.when(F.col("end.reply"), F.concat(before, last["head"])).otherwise(F.concat(before, whole(last))).alias("context"),
        F.when(F.col("end.reply"), F.concat(last["body"], F.lit(END))).otherwise("").alias("target"),
        F.when(F.col("end.reply"), F.length(last["body"])).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.split(formatted, END, -1)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            F.when(p.startswith("### ="), unescape(F.substring(F.substring_index(p, ": ", 1), 6, 2**31 - 1)))
            .otherwise(F.lower(F.substring(F.substring_index(p, ": ", 1), 5, 2**31 - 1)))
            .alias("role"),
            unescape(p.substr(F.length(F.substring_index(p, ": ", 1)) + 3, F.length(p))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples alone; the last example holds all turns."""
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    loss = unescape(F.substring("target", 1, F.col("loss_chars").cast("int")))
    grouped = examples.select("conv_id", "example", F.concat("context", "target").alias("text"), loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = read_back(F.col("whole"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return grouped.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        sha(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return digests(format_examples(turns.unionByName(control)))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text)
      + length(text) - length(replace(text, '\', ''))
      + 2 * ((length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)) AS body,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) + 6 ELSE NULL END AS head,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), summed AS (
  SELECT *, sum(head + body + 8) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM summed GROUP BY conv_id
"""
