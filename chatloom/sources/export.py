"""Chat exports: JSON documents whose texts are strings or lists of pieces.

An export is read as one variant per file, and its messages are exploded on the
executors, so a folder of exports is a distributed scan (a single document is
the unit of a task: JSON can't be split). What is a string and what is a list is
told by the variant's own type, never by the look of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.parsing import export_time, live_chat_id, sender_number, strip

SKIPPED = ("service",)
FIELDS = ("chat_id", "msg_id", "reply_to", "sender_id", "sender", "ts", "text")


def flatten_text(raw: Column) -> Column:
    """A variant text as a string: itself, or its strings and its objects' ``text`` in a row; anything else is empty."""
    kind = F.schema_of_variant(raw)

    def piece(x: Column) -> Column:
        inner = F.schema_of_variant(x)
        return (
            F.when(inner == "STRING", F.try_variant_get(x, "$", "string"))
            .when(F.startswith(inner, F.lit("OBJECT")), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
            .otherwise(F.lit(""))
        )

    parts = F.try_variant_get(raw, "$", "array<variant>")
    return (
        F.when(kind == "STRING", F.try_variant_get(raw, "$", "string"))
        .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(F.transform(parts, piece), ""))
        .otherwise(F.lit(""))
    )


def content_text(raw: Column) -> Column:
    """The text of a model's message content: a string, or the parts of type text; stripped."""
    kind = F.schema_of_variant(raw)

    def part(x: Column) -> Column:
        inner = F.schema_of_variant(x)
        is_text = F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("text")) == "text"
        return (
            F.when(inner == "STRING", F.try_variant_get(x, "$", "string"))
            .when(F.startswith(inner, F.lit("OBJECT")) & is_text, F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
            .otherwise(F.lit(""))
        )

    joined = F.array_join(F.transform(F.try_variant_get(raw, "$", "array<variant>"), part), "")
    return strip(F.when(kind == "STRING", F.try_variant_get(raw, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), joined).otherwise(F.lit("")))


def error_text(body: Column, fallback: Column) -> Column:
    """The message of a service's JSON error, never the raw body."""
    v = F.try_parse_json(body)
    nested = F.try_variant_get(v, "$.error.message", "string")
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$.error", "variant")) == "STRING", F.try_variant_get(v, "$.error", "string"))
    return F.coalesce(F.when(nested != "", nested), F.when(strip(plain) != "", plain), fallback)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(path, chat_id, raw_id, chat_name, entry): a row per entry of every export under ``path``.

    ``chat_id`` is the id the live chat has. A file without a chat id fails the
    job with a message that names it.
    """
    files = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).withColumn("path", F.input_file_name())
    raw = F.try_variant_get("v", "$.id", "bigint")
    checked = F.when(raw.isNull(), F.raise_error(F.concat(F.col("path"), F.lit(": no chat id in the export"))).cast("bigint")).otherwise(raw)
    heads = files.select(
        "path", checked.alias("raw_id"), F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("")).alias("kind"),
        F.coalesce(F.try_variant_get("v", "$.name", "string"), F.lit("?")).alias("chat_name"),
        F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.array().cast("array<variant>")).alias("entries"),
    )
    return heads.select("path", live_chat_id(F.col("raw_id"), F.col("kind")).alias("chat_id"), "raw_id", "chat_name", F.posexplode("entries").alias("pos", "entry"))


def entries_to_messages(entries: DataFrame) -> DataFrame:
    """Message rows of (chat_id, pos, entry), entries in their order of ``pos``.

    Service entries, blank texts, and entries without a time or an id are left
    out. A missing sender is the actor, else ``Unknown``. Of an id that comes
    twice the later text counts and the earlier rest, as in any upsert.
    """
    from chatloom.operators.store import upsert_messages

    get = lambda path, kind: F.try_variant_get("entry", path, kind)
    named = lambda path: F.when(get(path, "string") != "", get(path, "string"))
    rows = entries.where(F.coalesce(get("$.type", "string"), F.lit("")).isin(*SKIPPED) == F.lit(False)).select(
        "chat_id",
        get("$.id", "bigint").alias("msg_id"),
        get("$.reply_to_message_id", "bigint").alias("reply_to"),
        sender_number(get("$.from_id", "string")).alias("sender_id"),
        F.coalesce(named("$.from"), named("$.actor"), F.lit("Unknown")).alias("sender"),
        export_time(get("$.date_unixtime", "string"), get("$.date", "string")).alias("ts"),
        strip(flatten_text(F.try_variant_get("entry", "$.text", "variant"))).alias("text"),
        "pos",
    )
    usable = rows.where("text <> '' and ts is not null and msg_id is not null")
    return upsert_messages(usable, "pos").select(*FIELDS)


def load_exports(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """The message table after loading the exports under ``path`` into ``stored``; safe to repeat.

    Messages stored under an export's own id move to the live id first. An entry
    replaces the text of a stored message and nothing else.
    """
    entries = read_exports(spark, path)
    new = entries_to_messages(entries.select("chat_id", "pos", "entry"))
    if stored is None:
        return new
    moves = entries.where("raw_id <> chat_id").groupBy("raw_id").agg(F.max("chat_id").alias("live_id"))
    from chatloom.operators.store import merge_mapped, upsert_messages

    moved = stored.join(moves, stored["chat_id"] == moves["raw_id"], "left").select(
        F.coalesce("live_id", "chat_id").alias("chat_id"), "msg_id", F.col("live_id").isNotNull().alias("__moved"), *FIELDS[2:]
    )
    old = merge_mapped(moved).select(*FIELDS).withColumn("id", F.lit(0))
    return upsert_messages(old.unionByName(new.withColumn("id", F.lit(1)))).select(*FIELDS)


def load_counts(entries: DataFrame) -> DataFrame:
    """(chat_id, chat_name, in_file, usable) of each export."""
    usable = entries_to_messages(entries.select("chat_id", "pos", "entry")).groupBy("chat_id").agg(F.count("*").alias("usable"))
    return entries.groupBy("chat_id", "chat_name").agg(F.count("*").alias("in_file")).join(usable, "chat_id", "left").withColumn("usable", F.coalesce("usable", F.lit(0)))


def messages_to_entries(messages: DataFrame, pieces: Column | None = None) -> DataFrame:
    """(chat_id, pos, entry): messages as entries of an export; where ``pieces`` holds, the text is a list of a string and an object."""
    half = F.floor(F.length("text") / 2).cast("int")
    first = F.regexp_replace(F.to_json(F.array(F.col("text").substr(F.lit(1), half))), "\\]$", "")
    rest = F.to_json(F.struct(F.lit("bold").alias("type"), F.col("text").substr(half + 1, F.lit(1 << 30)).alias("text")))
    as_list = F.concat(first, F.lit(","), rest, F.lit("]"))
    as_text = F.regexp_replace(F.regexp_replace(F.to_json(F.array("text")), "^\\[", ""), "\\]$", "")
    head = F.to_json(
        F.struct(
            F.col("msg_id").alias("id"), F.lit("message").alias("type"), F.col("ts").cast("string").alias("date_unixtime"), F.col("sender").alias("from"),
            F.concat(F.lit("user"), F.col("sender_id").cast("string")).alias("from_id"), F.col("reply_to").alias("reply_to_message_id"),
        )
    )
    text = as_text if pieces is None else F.when(pieces, as_list).otherwise(as_text)
    entry = F.parse_json(F.concat(F.regexp_replace(head, "\\}$", ""), F.lit(',"text":'), F.coalesce(text, F.lit('""')), F.lit("}")))
    return messages.select("chat_id", F.lit(0).alias("pos"), entry.alias("entry"))


def read_mapping(spark: SparkSession, path: str, source: str = "manual") -> DataFrame:
    """A list of {sender_id, name, username} as rows of people."""
    rows = spark.read.schema("sender_id bigint, name string, username string").option("multiLine", True).json(path)
    return rows.select("sender_id", F.col("name").alias("display_name"), "username", F.lit(source).alias("source"), F.lit(None).cast("bigint").alias("updated_at"))


def write_template(template: DataFrame, path: str) -> None:
    """The senders for a mapping, as JSON lines, the busiest first within each file."""
    template.repartitionByRange(F.desc("messages"), "sender_id").sortWithinPartitions(F.desc("messages"), "sender_id").write.mode("overwrite").json(path)


def append_query_log(log: DataFrame, path: str, enabled: bool = True) -> None:
    """Appends ts, question, chat_ids, window_ids, cited_ids, latency_ms, model; the id lists as JSON text as well."""
    if not enabled:
        return
    lists = {f"{c}_json": F.to_json(c) for c in ("chat_ids", "window_ids", "cited_ids")}
    log.withColumns(lists).write.mode("append").parquet(path)
