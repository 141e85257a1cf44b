"""Queries p4_*: conversations from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm.conversations import conversation_texts, conversations
from chatloom.session import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(read_table(spark, sf_dir, "messages")).select("chat_id", "root_msg", "seq", "msg_id")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_texts(read_table(spark, sf_dir, "messages")).select("chat_id", "root_msg", "seq", "msg_id", "ts", "sender_id", "role", "text")


_SQL = """
WITH RECURSIVE cur AS (
  SELECT chat_id, msg_id, m.ts AS ts, m.reply_to AS reply_to, m.sender_id AS sender_id, m.text AS text,
    NOT regexp_matches(m.text, '[^\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]') AS blank
  FROM (SELECT chat_id, msg_id, arg_max({'ts': ts, 'reply_to': reply_to, 'sender_id': sender_id, 'text': text}, id) AS m FROM messages GROUP BY 1, 2)
), conv AS (
  SELECT chat_id, msg_id AS root_msg, msg_id, ts, sender_id, blank, text, false AS early FROM cur WHERE reply_to IS NULL
  UNION ALL
  SELECT c.chat_id, v.root_msg, c.msg_id, c.ts, c.sender_id, c.blank, c.text, c.ts < v.ts
  FROM conv v JOIN cur c ON c.chat_id = v.chat_id AND c.reply_to = v.msg_id
), kept AS (
  SELECT c.chat_id, c.root_msg, any_value(o.sender_id) AS asker
  FROM conv c JOIN conv o ON o.chat_id = c.chat_id AND o.msg_id = c.root_msg
  WHERE o.sender_id IS NOT NULL AND NOT o.blank
  GROUP BY 1, 2
  HAVING NOT bool_or(c.early) AND bool_or(coalesce(c.msg_id <> c.root_msg AND NOT c.blank AND c.sender_id <> o.sender_id, false))
)
SELECT %s FROM conv JOIN kept USING (chat_id, root_msg)
"""
_SEQ = "row_number() OVER (PARTITION BY chat_id, root_msg ORDER BY ts, msg_id) AS seq"

QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns}
ORACLES = {
    "p4_found": _SQL % f"chat_id, root_msg, {_SEQ}, msg_id",
    "p4_turns": _SQL % f"chat_id, root_msg, {_SEQ}, msg_id, ts, sender_id, CASE WHEN sender_id = asker THEN 'asker' ELSE 'answerer' END AS role, text",
}
