"""Who people are: known names, whom a question asks about, who may ask, and counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.parsing import SPEAKER_CUE, asks_about


def known_names(people: DataFrame, messages: DataFrame | None = None, mode: str = "name") -> DataFrame:
    """(display_name): the names a question may hold; private labels only where windows show them (mode export)."""
    names = people.where("display_name <> ''").select("display_name")
    if mode == "export" and messages is not None:
        names = names.unionByName(messages.where("sender <> ''").select(F.col("sender").alias("display_name")))
    return names.distinct()


def asked_speakers(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, speaker): whom each text (id, text) asks about, by a cue word and a turn of phrase.

    Of several the longest, of equally long ones the first in small letters. Only
    texts with a cue word are looked at, and names meet them on a word of the
    name, so there is no comparison of all with all.
    """
    cued = texts.select("id", "text").where(F.col("text").rlike(SPEAKER_CUE))
    word = F.regexp_extract(F.lower("display_name"), "([\\p{L}\\p{N}]+)", 1)
    keyed = names.select("display_name").distinct().where(F.length("display_name") >= 3).withColumn("key", word).where("key <> ''")
    words = cued.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)")))))
    asked = words.join(keyed, "key").where(asks_about(F.col("text"), F.col("display_name")))
    best = asked.groupBy("id").agg(F.min(F.struct((-F.length("display_name")).alias("n"), F.lower("display_name").alias("low"), "display_name")).alias("m"))
    return best.select("id", F.col("m.display_name").alias("speaker"))


def people_counts(messages: DataFrame, people: DataFrame) -> DataFrame:
    """One row: senders, resolved, unresolved, and by_source (a map of how many names come from where)."""
    senders = messages.agg(F.countDistinct("sender_id").alias("senders"))
    sources = people.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    by = sources.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"), F.coalesce(F.sum("n"), F.lit(0)).alias("resolved"))
    return senders.join(F.broadcast(by)).select("senders", "resolved", (F.col("senders") - F.col("resolved")).alias("unresolved"), "by_source")


def busiest_first(template: DataFrame, limit: int | None = None) -> DataFrame:
    """The senders of a template in one order: most messages first, then the smaller id; ``place`` counts from 1 to ``limit``."""
    order = [F.desc("messages"), F.col("sender_id")]
    if limit is not None:
        template = template.orderBy(*order).limit(limit)
        return template.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return template.orderBy(*order)


def allowed_requests(requests: DataFrame, members: DataFrame, chat_id: int) -> DataFrame:
    """Requests (chat_id, user_id, is_group) that may be answered: a group must be the configured chat, a private talk needs a current member.

    ``members``: (user_id, member) as last looked up; a failed look-up is null and means no.
    """
    inside = members.where("member").select("user_id").distinct().withColumn("__in", F.lit(True))
    joined = requests.join(inside, "user_id", "left")
    return joined.where(F.when(F.col("is_group"), F.col("chat_id") == chat_id).otherwise(F.coalesce("__in", F.lit(False)))).drop("__in")


def commands_for(commands: DataFrame, users: DataFrame, admins: DataFrame) -> DataFrame:
    """(user_id, command): what each user is offered; ``commands`` has (command, admin_only), those are for ``admins`` (user_id)."""
    marked = users.select("user_id").join(admins.select("user_id").distinct().withColumn("__admin", F.lit(True)), "user_id", "left")
    # a list of commands is a handful of rows
    return marked.join(F.broadcast(commands)).where(~F.col("admin_only") | F.coalesce("__admin", F.lit(False))).select("user_id", "command")
