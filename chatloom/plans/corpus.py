"""Queries p2_*: sessions, from the general part of the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.sessions import current_messages, cut_tree, gap_tree, sessions
from chatloom.session import cut_lineage, read_table

GAP = 1800
GAPS = (600, 1800, 7200, 86400)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(read_table(spark, sf_dir, "messages"), GAP).select("chat_id", "first_msg", "last_msg")


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(read_table(spark, sf_dir, "messages"), GAP)


def p2_gap_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree, cut at several gaps, without the replies."""
    current = current_messages(read_table(spark, sf_dir, "messages"), "ts")
    events = cut_lineage(current.select(F.col("chat_id").alias("entity"), "ts", F.col("msg_id").alias("id"), F.lit(None).cast("long").alias("ref")))
    tree = cut_lineage(gap_tree(events))
    cuts = [cut_tree(tree, gap).withColumn("gap_s", F.lit(gap)) for gap in GAPS]
    return reduce(DataFrame.unionByName, cuts).select(
        "gap_s",
        F.col("entity").alias("chat_id"),
        F.col("first_id").alias("first_msg"),
        F.col("last_id").alias("last_msg"),
        F.col("first_ts").alias("start_ts"),
        F.col("last_ts").alias("end_ts"),
        (F.col("last_ts") - F.col("first_ts")).alias("duration"),
        F.col("n").alias("messages"),
    )


P2_GAP_SETTINGS_SQL = f"""
WITH m AS (
  SELECT chat_id, msg_id, max_by(ts, id) AS ts FROM messages
  WHERE chat_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY 1, 2
), g AS (
  SELECT gap_s, chat_id, msg_id, ts,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY gap_s, chat_id ORDER BY ts, msg_id) <= gap_s THEN 0 ELSE 1 END AS opens
  FROM m CROSS JOIN (VALUES {", ".join(f"({g})" for g in GAPS)}) AS v(gap_s)
), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY gap_s, chat_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS k FROM g
)
SELECT CAST(gap_s AS INTEGER) AS gap_s, chat_id, arg_min(msg_id, (ts, msg_id)) AS first_msg, arg_max(msg_id, (ts, msg_id)) AS last_msg,
  min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration, count(*) AS messages
FROM s GROUP BY gap_s, chat_id, k
"""

# row by row: a message opens a session after a silence that no reply into the session bridges
_SESSIONS_SQL = f"""
WITH RECURSIVE cur AS (
  SELECT chat_id, msg_id, m.ts AS ts, m.reply_to AS reply_to FROM (
    SELECT chat_id, msg_id, arg_max({{'ts': ts, 'reply_to': reply_to}}, id) AS m FROM messages WHERE chat_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY 1, 2)
), o AS (
  SELECT *, row_number() OVER w AS rn, ts - lag(ts) OVER w AS gap FROM cur WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY chat_id ORDER BY ts, msg_id)
), r AS (SELECT a.*, b.rn AS target FROM o a LEFT JOIN o b ON b.chat_id = a.chat_id AND b.msg_id = a.reply_to)
, f AS (
  SELECT chat_id, rn, rn AS opened FROM r WHERE rn = 1
  UNION ALL
  SELECT r.chat_id, r.rn, CASE WHEN r.gap > {GAP} AND NOT coalesce(r.target BETWEEN f.opened AND r.rn - 1, false) THEN r.rn ELSE f.opened END
  FROM f JOIN r ON r.chat_id = f.chat_id AND r.rn = f.rn + 1
), s AS (SELECT f.chat_id, f.opened, o.rn, o.msg_id, o.ts FROM f JOIN o USING (chat_id, rn))
SELECT chat_id, arg_min(msg_id, rn) AS first_msg, arg_max(msg_id, rn) AS last_msg%s FROM s GROUP BY chat_id, opened
"""

QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p2_gap_settings": p2_gap_settings}
ORACLES = {
    "p2_gap_settings": P2_GAP_SETTINGS_SQL, "p2_found": _SESSIONS_SQL % "",
    "p2_sessions": _SESSIONS_SQL % ", min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration, count(*) AS messages",
}
