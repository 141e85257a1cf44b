"""Incremental indexing: which windows to rebuild, and the rebuilt table.

The plan is data, not a driver loop: one row per chat with the message id from
which its windows are stale. Windows before that id are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.windows import WindowRules, labelled, render_windows, window_members

DAY = 86_400


def pending(messages: DataFrame, state: DataFrame) -> DataFrame:
    """(chat_id, pending): messages above each chat's high-water mark; a chat without one counts from 0."""
    marked = messages.select("chat_id", "msg_id").join(state.select("chat_id", "last_indexed_msg_id"), "chat_id", "left")
    return marked.groupBy("chat_id").agg(F.count_if(F.col("msg_id") > F.coalesce("last_indexed_msg_id", F.lit(0))).alias("pending"))


def due(messages: DataFrame, state: DataFrame, every: int = 20) -> DataFrame:
    """Chats with at least ``every`` pending messages."""
    return pending(messages, state).where(F.col("pending") >= every)


def boundaries(messages: DataFrame, windows: DataFrame, lookback_days: int = 0) -> DataFrame:
    """(chat_id, tail, lookback, boundary): where a rebuild starts.

    ``tail`` is the first message of the chat's last window, which is still open
    (0 without windows). ``lookback`` is the first message of the windows that
    end within so many days of the chat's latest message. The boundary is the
    smaller of the two.
    """
    latest = messages.groupBy("chat_id").agg(F.max("ts").alias("latest"))
    tail = windows.groupBy("chat_id").agg(F.max(F.struct("last_msg", "id", "first_msg")).alias("m")).select("chat_id", F.col("m.first_msg").alias("tail"))
    recent = windows.join(latest, "chat_id").where(F.col("ts_end") >= F.col("latest") - lookback_days * DAY)
    back = recent.groupBy("chat_id").agg(F.min("first_msg").alias("lookback"))
    joined = latest.join(tail, "chat_id", "left").join(back, "chat_id", "left").withColumn("tail", F.coalesce("tail", F.lit(0)))
    boundary = F.least("tail", F.coalesce("lookback", "tail")) if lookback_days else F.col("tail")
    return joined.select("chat_id", "tail", "lookback", boundary.alias("boundary"))


def plan_update(messages: DataFrame, windows: DataFrame, state: DataFrame, lookback_days: int = 0, force: bool = False) -> DataFrame:
    """(chat_id, boundary) of the chats to rebuild: those with pending messages, or all with a lookback or by force."""
    plan = boundaries(messages, windows, lookback_days)
    if not (lookback_days or force):
        plan = plan.join(pending(messages, state).where("pending > 0").select("chat_id"), "chat_id", "left_semi")
    return plan.select("chat_id", "boundary")


def plan_reindex(messages: DataFrame) -> DataFrame:
    return messages.select("chat_id").distinct().withColumn("boundary", F.lit(0).cast("bigint"))


def plan_edits(windows: DataFrame, edits: DataFrame) -> DataFrame:
    """(chat_id, boundary) of the chats whose edited messages (chat_id, msg_id) lie in the open tail; older edits wait."""
    tail = windows.groupBy("chat_id").agg(F.max(F.struct("last_msg", "id", "first_msg")).alias("m")).select("chat_id", F.col("m.first_msg").alias("boundary"))
    return edits.groupBy("chat_id").agg(F.max("msg_id").alias("msg_id")).join(tail, "chat_id").where(F.col("msg_id") >= F.col("boundary")).select("chat_id", "boundary")


def rebuild(
    messages: DataFrame, windows: DataFrame, people: DataFrame, aliases: DataFrame, plan: DataFrame, rules: WindowRules = WindowRules(), mode: str = "name",
) -> DataFrame:
    """The window table after the plan: rows without an id are new and lack a vector.

    Rows of ``windows`` with first_msg at or above their chat's boundary are
    dropped; messages from there on are windowed anew, as if nothing preceded
    them. ``plan`` has at most a row per chat.
    """
    kept = windows.join(plan, "chat_id", "left").where("boundary is null or first_msg < boundary").drop("boundary")
    stale = messages.join(plan, "chat_id").where("msg_id >= boundary").drop("boundary")
    new = render_windows(window_members(stale, rules), labelled(stale, people, aliases, mode))
    return kept.unionByName(new.withColumn("id", F.lit(None).cast("bigint")))


def watermarks(messages: DataFrame, plan: DataFrame, state: DataFrame) -> DataFrame:
    """The state after the plan: the highest message id of each rebuilt chat, others as they were."""
    done = messages.join(plan.select("chat_id"), "chat_id", "left_semi").groupBy("chat_id").agg(F.max("msg_id").alias("last_indexed_msg_id"))
    return state.join(done.select("chat_id"), "chat_id", "left_anti").select("chat_id", "last_indexed_msg_id").unionByName(done)
