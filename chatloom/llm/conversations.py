"""Conversations rebuilt from a log of message deliveries.

The rows are an event log: creates, edits, retries and deletes (deliveries with a
null text) of a message are folded by version (the delivery's ``id``) into its
final turn; a message whose last version is a delete is gone. Turns are hung under the
opening message they lead to by pointer doubling over ``reply_to``: each round
doubles the number of replies that are skipped, so a chain of n replies takes
log2(n) rounds, and a round without a newly found root proves that what is left
runs in circles or leads to a missing message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.ordered import rank_in_groups
from chatloom.operators.sessions import current_messages
from chatloom.session import cut_lineage

# fixed values: any kind of white space (Unicode's White_Space and the four information separators)
NOT_BLANK = "[^\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def final_turns(messages: DataFrame) -> DataFrame:
    """chat_id, msg_id, ts, reply_to, sender_id, blank: the current row of each message that isn't deleted.

    A null text is a delete, which a later version undoes. Rows without chat_id
    or msg_id are left out.
    """
    blank = ~F.col("text").rlike(NOT_BLANK)  # null for a delete
    flagged = messages.select("id", "chat_id", "msg_id", "ts", "reply_to", "sender_id", blank.alias("blank"))
    return current_messages(flagged, "ts", "reply_to", "sender_id", "blank").where("blank is not null")


def roots_of(turns: DataFrame) -> DataFrame:
    """(chat_id, msg_id, root_msg, early): the opening message each reply leads to.

    ``turns`` has chat_id, msg_id, ts, reply_to. ``early``: the reply's ts is
    before that of the message it answers (a null ts is never early). Replies
    that lead to no opening message don't come out.
    """
    parents = turns.select("chat_id", F.col("msg_id").alias("reply_to"), F.col("ts").alias("parent_ts"), F.col("reply_to").isNull().alias("done"))
    replies = turns.where("reply_to is not null").join(parents, ["chat_id", "reply_to"])
    state = cut_lineage(
        replies.select("chat_id", "msg_id", F.col("reply_to").alias("at"), "done", F.coalesce(F.col("ts") < F.col("parent_ts"), F.lit(False)).alias("early"))
    )
    done, pending = state.where("done"), state.where("not done")
    resolved, left = [done], pending.count()
    while left:
        # whoever will step on a reply that has found its root stands before it by now; the others need not come along
        needed = pending.select("chat_id", F.col("at").alias("msg_id")).distinct()
        done = cut_lineage(done.join(needed, ["chat_id", "msg_id"], "left_semi"))
        step = done.unionByName(pending).select("chat_id", F.col("msg_id").alias("at"), F.col("at").alias("next"), F.col("done").alias("next_done"))
        moved = cut_lineage(pending.join(step, ["chat_id", "at"]).select("chat_id", "msg_id", F.col("next").alias("at"), F.col("next_done").alias("done"), "early"))
        found, pending = moved.where("done"), moved.where("not done")
        resolved.append(found)
        done = done.unionByName(found)
        still = pending.count()
        if still == left:
            break
        left = still
    every = reduce(DataFrame.unionByName, resolved)
    return every.select("chat_id", "msg_id", F.col("at").alias("root_msg"), "early")


def conversations(messages: DataFrame) -> DataFrame:
    """chat_id, root_msg, seq, msg_id, ts, sender_id, role, blank: the turns of every kept conversation.

    A conversation is a message without ``reply_to`` and all messages that answer
    it, directly or through others. It is kept if the opening message has a
    sender_id and isn't blank, if at least one other message isn't blank and has
    a sender_id that differs from the opener's, and if no message in it has a ts
    before that of the message it answers. ``seq`` counts from 1 in order of
    (ts, msg_id); ``role`` is ``asker`` for the opener's messages, else
    ``answerer``, also where sender_id is null.

    Rows with a null chat_id, msg_id or ts can't be ordered and are left out
    before anything else, so what answers them leads nowhere. Repeated
    deliveries count once, by the highest ``id``; if that one's text is null, the
    message is deleted, and what answers it leads nowhere. An empty table gives no row;
    further columns are ignored.
    """
    turns = cut_lineage(final_turns(messages).where("ts is not null"))
    replies = roots_of(turns)
    openers = turns.where("reply_to is null").select("chat_id", "msg_id", F.col("msg_id").alias("root_msg"), F.lit(False).alias("early"))
    placed = replies.unionByName(openers)
    members = placed.join(turns.drop("reply_to"), ["chat_id", "msg_id"])
    opening = F.col("msg_id") == F.col("root_msg")
    answer = ~opening & ~F.col("blank")
    members = cut_lineage(members)
    kept = (
        members.groupBy("chat_id", "root_msg")
        .agg(
            F.max(F.when(opening, F.col("sender_id"))).alias("asker"),
            F.bool_or(opening & ~F.col("blank")).alias("asked"),
            F.min(F.when(answer, F.col("sender_id"))).alias("least"),
            F.max(F.when(answer, F.col("sender_id"))).alias("most"),
            F.bool_or("early").alias("broken"),
        )
        .where("asked and not broken and asker is not null and (least <> asker or most <> asker)")
        .select("chat_id", "root_msg", "asker")
    )
    turns_kept = members.join(kept, ["chat_id", "root_msg"])
    role = F.when(F.col("sender_id") == F.col("asker"), "asker").otherwise("answerer")
    ordered = turns_kept.select("chat_id", "root_msg", "ts", "msg_id", "sender_id", role.alias("role"), "blank")
    return rank_in_groups(ordered, ["chat_id", "root_msg"], ["ts", "msg_id"], "seq")


def conversation_texts(messages: DataFrame) -> DataFrame:
    """``conversations`` with the text of each turn's current row."""
    current = current_messages(messages.select("id", "chat_id", "msg_id", "text"), "text")
    return conversations(messages).join(current, ["chat_id", "msg_id"])
