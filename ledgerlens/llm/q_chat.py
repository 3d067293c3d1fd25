"""Query: chat formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat
from .common import table
from .q_tokens import vocabulary
from .registry import register

#: a conversation whose texts hold the template's own control strings
HARD_TEXT = "\\### Assistant: </turn> ok"
FIRST_RESERVED = 50257

OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10) AS line,
  regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\', '\\\\', 'g'), '### ', '#\\## ', 'g'), '</turn>', '<\\/turn>', 'g') AS esc FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(esc) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@register("op9_chat_format", OP9_SQL)
def op9_chat_format(spark, sf_dir):
    own = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)],
                                "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    path = vocabulary("byte_bpe_50k.json")
    formatted = chat.format_conversations(turns.unionByName(own), path, FIRST_RESERVED)
    return chat.conversation_digests(formatted, path, FIRST_RESERVED)
