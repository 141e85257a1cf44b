"""Keyed upserts, merges and derived dimensions over plain tables.

Parquet tables have no MERGE: an upsert is union, reduce by key, write as a new
version. All reductions are partial aggregates, so a key with many deliveries
is folded before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.operators.ordered import rank_in_groups

_LOWEST = -(2**63)


def _seq(column: Column) -> Column:
    return F.coalesce(column.cast("bigint"), F.lit(_LOWEST))


def upsert_messages(deliveries: DataFrame, seq: str = "id") -> DataFrame:
    """One row per (chat_id, msg_id): text of the last delivery, all else as first seen.

    Deliveries are ordered by ``seq``; null comes first, ties are decided by the
    values. Rows with a null key are left out.
    """
    rest = F.struct(_seq(F.col(seq)).alias("s"), "reply_to", "sender_id", "sender", "ts")
    return (
        deliveries.dropna(subset=["chat_id", "msg_id"])
        .groupBy("chat_id", "msg_id")
        .agg(F.min(rest).alias("first"), F.max(F.struct(_seq(F.col(seq)).alias("s"), "text")).alias("last"))
        .select("chat_id", "msg_id", *[F.col(f"first.{c}").alias(c) for c in ("reply_to", "sender_id", "sender", "ts")], F.col("last.text").alias("text"))
    )


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of equal keys; ``new`` has a row per key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def key_values(changes: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value of each key; a key whose last value is null is gone."""
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(_seq(F.col(seq)).alias("s"), value)).alias("m"))
    return last.select(key, F.col(f"m.{value}").alias(value)).where(F.col(value).isNotNull())


def trust(source: Column) -> Column:
    """live 0, api 1, manual 2, anything else 0."""
    return F.when(source == "manual", 2).when(source == "api", 1).otherwise(0)


def merge_people(changes: DataFrame, seq: str) -> DataFrame:
    """The stored name of each sender: a less trusted name never replaces a more trusted one, an equal one does.

    Rows without sender_id or with an empty name write nothing. Names are trimmed.
    """
    valid = changes.where(F.col("sender_id").isNotNull() & (F.coalesce(F.col("display_name"), F.lit("")) != ""))
    best = F.max(F.struct(trust(F.col("source")).alias("t"), _seq(F.col(seq)).alias("s"), "display_name", "username", "source", "updated_at")).alias("m")
    return valid.groupBy("sender_id").agg(best).select(
        "sender_id", F.trim(F.col("m.display_name")).alias("display_name"), *[F.col(f"m.{c}").alias(c) for c in ("username", "source", "updated_at")]
    )


def merge_chats(messages: DataFrame, old: Column | int, new: Column | int) -> DataFrame:
    """``messages`` with chat ``old`` moved onto ``new``; where both have a message, that of ``new`` stays."""
    old, new = (F.lit(x) if isinstance(x, int) else x for x in (old, new))
    moved = messages.withColumn("__moved", F.coalesce(F.col("chat_id") == old, F.lit(False))).withColumn("chat_id", F.when(F.col("chat_id") == old, new).otherwise(F.col("chat_id")))
    return merge_mapped(moved)


def merge_mapped(moved: DataFrame) -> DataFrame:
    """A row per (chat_id, msg_id), those with ``__moved`` giving way."""
    others = [c for c in moved.columns if c not in ("chat_id", "msg_id", "__moved")]
    best = moved.groupBy("chat_id", "msg_id").agg(F.min(F.struct("__moved", *others)).alias("m"))
    return best.select("chat_id", "msg_id", *[F.col(f"m.{c}").alias(c) for c in others])


def merge_state(state: DataFrame, old: int, new: int) -> DataFrame:
    """The high-water marks after a merge of chats: the larger of the two."""
    chat = F.when(F.col("chat_id") == old, F.lit(new)).otherwise(F.col("chat_id"))
    return state.groupBy(chat.alias("chat_id")).agg(F.max("last_indexed_msg_id").alias("last_indexed_msg_id"))


def assign_aliases(senders: DataFrame, aliases: DataFrame) -> DataFrame:
    """``aliases`` with the senders that had none, numbered on from the highest ordinal in order of id.

    The numbering is distributed: it needs no single task.
    """
    fresh = senders.where("sender_id is not null").select("sender_id").distinct().join(aliases.select("sender_id"), "sender_id", "left_anti")
    top = aliases.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("top"))  # one row
    ranked = rank_in_groups(fresh.withColumn("one", F.lit(1)), ["one"], ["sender_id"], "k")
    return aliases.select("sender_id", "ordinal").unionByName(ranked.join(F.broadcast(top)).select("sender_id", (F.col("k") + F.col("top")).alias("ordinal")))


def sender_template(messages: DataFrame, people: DataFrame) -> DataFrame:
    """sender_id, messages, name, source of every sender, for a mapping to be edited."""
    counts = messages.where("sender_id is not null").groupBy("sender_id").agg(F.count("*").alias("messages"), F.max("sender").alias("sender"))
    return counts.join(people.select("sender_id", "display_name", "source"), "sender_id", "left").select(
        "sender_id", "messages", F.coalesce("display_name", "sender").alias("name"), F.coalesce("source", F.lit("export-label")).alias("source")
    )


def table_stats(messages: DataFrame, windows: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: messages, chats, windows, embedded, first and last message."""
    from chatloom.functions.parsing import utc_label

    a = messages.agg(F.count("*").alias("messages"), F.countDistinct("chat_id").alias("chats"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    b, c = windows.agg(F.count("*").alias("windows")), vectors.agg(F.count("*").alias("embedded"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select(
        "messages", "windows", "embedded", "chats", utc_label(F.col("lo")).alias("first_message"), utc_label(F.col("hi")).alias("last_message")
    )


def without_orphans(vectors: DataFrame, windows: DataFrame) -> DataFrame:
    """Vectors whose window exists: what a cascading delete leaves."""
    return vectors.join(windows.select(F.col("id").alias("window_id")), "window_id", "left_semi")


def pending_vectors(windows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Windows without a vector: the work of the encoder, derived from the data, so that a crash heals itself."""
    return windows.join(vectors.select(F.col("window_id").alias("id")), "id", "left_anti")


def replace_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(vectors, new, ["window_id"])


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def ensure_column(df: DataFrame, name: str, kind: str | T.DataType) -> DataFrame:
    """``df`` with a column of nulls where it has none of that name. Raises ValueError for what is no identifier."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a column name: {name!r}")
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` as the columns of ``schema``, missing ones null, further ones dropped."""
    for field in schema.fields:
        df = ensure_column(df, field.name, field.dataType)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def scoped(df: DataFrame, chats: int | list[int] | tuple[int, ...] | None, column: str = "chat_id") -> DataFrame:
    """An allow-list of chats: None is all, an empty list none. Strings are refused."""
    if chats is None:
        return df
    if isinstance(chats, (str, bytes)):
        raise TypeError("chats must be an id or a sequence of ids")
    ids = [chats] if isinstance(chats, int) else [int(c) for c in chats]
    return df.where(F.col(column).isin(ids)) if ids else df.where(F.lit(False))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by a window whose limit is pushed before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
