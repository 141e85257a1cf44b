"""Scalar parsers as column expressions: no Python worker is involved.

Each function takes and returns Spark columns. Null in, null out, unless said
otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tokens

WORD = "[\\p{L}\\p{N}_]+"
TERM = "[\\p{L}\\p{N}]+"


# fixed values: white space of any kind, as Python strips it
SPACE = "\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


# fixed values: combining marks that the index drops
DROPPED = "".join(map(chr, (*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331)))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with one mark, and the letters they are without it: by Unicode's own decomposition."""
    pairs = {"\u017f": "s", "\u1e9b": "s"}  # the long s
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            pairs[chr(code).lower() if len(chr(code).lower()) == 1 else chr(code)] = parts[0].lower()
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _plain_letters()


def fold(text: Column) -> Column:
    """Small letters; Latin ones with one mark lose it, those with more and other scripts keep theirs, loose marks fall away."""
    return F.translate(F.lower(text), MARKED + DROPPED, PLAIN)


def document_terms(text: Column) -> Column:
    """The terms of an indexed text, in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"))


def query_tokens(question: Column) -> Column:
    """The tokens of a question: runs of letters, digits and underscores of two or more characters, folded."""
    found = F.regexp_extract_all(fold(F.coalesce(question, F.lit(""))), F.lit(f"({WORD})"))
    return F.filter(found, lambda t: F.length(t) > 1)


def words_in_order(token: Column) -> Column:
    """The terms an underscored token is made of; they have to follow one another in a document."""
    return F.filter(F.split(token, "_"), lambda t: t != "")


# ---------------------------------------------------------------- ids, times, senders

# fixed values: kinds of chats in an export
CHANNELS = ("private_supergroup", "public_supergroup", "private_channel", "public_channel")
GROUPS = ("private_group", "public_group", "group")


def live_chat_id(raw: Column, kind: Column) -> Column:
    """The id a live chat has for the id of its export: -100<id> for channels and large groups, -id for small ones."""
    kind = F.coalesce(kind, F.lit(""))
    channel = kind.isin(*CHANNELS) | F.contains(kind, F.lit("supergroup")) | F.endswith(kind, F.lit("channel"))
    return F.when(raw < 0, raw).when(channel, F.concat(F.lit("-100"), raw.cast("string")).cast("bigint")).when(kind.isin(*GROUPS), -raw).otherwise(raw)


def export_chat_ids(live: Column) -> Column:
    """The export ids under which a live chat may already be stored."""
    text = live.cast("string")
    return (
        F.when(F.startswith(text, F.lit("-100")) & (F.length(text) > 4), F.array(F.substring(text, 5, 30).cast("bigint")))
        .when(live < 0, F.array(-live))
        .otherwise(F.array().cast("array<bigint>"))
    )


def candidate_chat_ids(stored: Column) -> Column:
    """The live ids a stored id may stand for, the likeliest first."""
    return F.when(stored < 0, F.array(stored)).otherwise(F.array(stored, F.concat(F.lit("-100"), stored.cast("string")).cast("bigint"), -stored))


def configured_chat_id(raw: Column) -> Column:
    """A chat id as typed into a setting: blank is null, a positive number is that of a large group."""
    n = F.expr("try_cast(NULL AS bigint)") if raw is None else F.trim(raw).try_cast("bigint")
    return F.when(n > 0, F.concat(F.lit("-100"), n.cast("string")).try_cast("bigint")).otherwise(n)


def sender_number(raw: Column) -> Column:
    """The digits of a sender id such as "user123"; null where there are none."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(digits != "", digits).try_cast("bigint")


def export_time(unixtime: Column, date: Column) -> Column:
    """Epoch seconds: the unixtime if it is a whole number, else the ISO date, read as UTC."""
    return F.coalesce(F.trim(unixtime).try_cast("bigint"), F.unix_timestamp(F.try_to_timestamp(date)))


def utc_minute(ts: Column) -> Column:
    """YYYY-MM-DD HH:MM of epoch seconds, in UTC whatever the session's zone."""
    return F.date_format(F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=ts.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm")


def utc_day(ts: Column) -> Column:
    return F.substring(utc_minute(ts), 1, 10)


def utc_label(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM UTC``; null stays null."""
    return F.concat(utc_minute(ts), F.lit(" UTC"))


def display_time(ts: Column, hours: Column) -> Column:
    """Wall-clock time at an offset of whole hours, with its label; an offset outside -12..14 counts as 2."""
    h = F.when(hours.between(-12, 14), hours).otherwise(2)
    at = F.date_format(F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ts + h * 3600).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")
    return F.concat(at, F.lit(" UTC"), F.when(h < 0, "-").otherwise("+"), F.lpad(F.abs(h).cast("string"), 2, "0"), F.lit(":00"))


# ---------------------------------------------------------------- speakers


def alias_label(sender_id: Column, ordinal: Column) -> Column:
    """``User N`` by the alias, ``User #id`` without one, ``User unknown`` without a sender."""
    return (
        F.when(sender_id.isNull(), F.lit("User unknown"))
        .when(ordinal.isNotNull(), F.concat(F.lit("User "), ordinal.cast("string")))
        .otherwise(F.concat(F.lit("User #"), sender_id.cast("string")))
    )


def speaker_label(sender_id: Column, display_name: Column, sender: Column, ordinal: Column, mode: str = "name") -> Column:
    """How a speaker is shown. name: the public name, else the alias; id: the alias; export: also the private label."""
    alias = alias_label(sender_id, ordinal)
    if mode == "id":
        return alias
    name = F.when(sender_id.isNotNull() & (display_name != ""), display_name)
    if mode == "export":
        return F.coalesce(name, F.when(sender != "", sender), alias)
    return F.coalesce(name, alias)


def chat_link(chat_id: Column, first_msg: Column, base: str = "https://t.me/c/") -> Column:
    """Deep link to a message: the chat id without -100, or without its minus signs."""
    bare = F.regexp_replace(chat_id.cast("string"), "^(-100|-+)", "")
    return F.concat(F.lit(base), bare, F.lit("/"), first_msg.cast("string"))


# ---------------------------------------------------------------- questions

# fixed values: words that lead to a speaker, and the turns of phrase that name one
SPEAKER_CUE = "(?iu)\\b(did|said|says|told|tell|from|by|according to)\\b"


def asks_about(question: Column, name: Column) -> Column:
    """Whether a question asks what a person said, by a cue word and one of three turns of phrase."""
    n = F.concat(F.lit("\\Q"), F.lower(name), F.lit("\\E"))
    turns = F.concat(
        F.lit("(?iu)\\b(?:what |who )?did "), n, F.lit(" (?:say|tell|ask)\\b|\\b"), n, F.lit(" (?:said|says|told|wrote)\\b|\\b(?:from|by|according to) "), n, F.lit("\\b")
    )
    return question.rlike(SPEAKER_CUE) & (F.length(name) >= 3) & F.rlike(F.lower(question), turns)


# fixed values: openings of a question that goes on from the one before
FOLLOW_UP = (
    "(?isu)^(what about(\\s+\\w+){0,3}\\??$|(and|also)\\s+(what|how|who|when|why|the)\\b|how much (was|is|were|are) (it|that|those|them)\\b|"
    "(who|what|when|where|why|how) (was|is|were|are) (it|that|this)\\b|the other one\\b|(and|also|wait)[,!]?\\s+)"
)
# fixed values: words that stand for what was said before
PRONOUN = "(?iu)\\b(it|that|those|them|this|one)\\b"


def is_follow_up(question: Column) -> Column:
    """A continuing opening, or at most five words with a pronoun."""
    q = strip(question)
    short = (F.size(F.split(q, f"[{SPACE}]+")) <= 5) & q.rlike(PRONOUN)
    return F.coalesce((q != "") & (q.rlike(FOLLOW_UP) | short), F.lit(False))


def standalone(question: Column, prior: Column, force: Column | bool = False) -> Column:
    """The question to search for: the one before is put in front of a follow-up."""
    q, p = strip(question), strip(F.coalesce(prior, F.lit("")))
    force = F.lit(force) if isinstance(force, bool) else F.coalesce(force, F.lit(False))
    return F.when((p != "") & (force | is_follow_up(question)), F.concat(p, F.lit(" — follow-up: "), q)).otherwise(q)


MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(september|february|november|december|january|october|august|march|april|sept|june|july|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_DAY = 86_400


def time_range(question: Column, now: Column) -> Column:
    """struct(start, end, label) of the first time phrase of a question, null without one.

    ``now`` is epoch seconds, UTC. The order decides which phrase counts: an ISO
    date, in <month>, since <month>, last night, yesterday, today, this week,
    last or past week, this month, last month, this year, last year. Ranges are
    closed. A month without a year is the last one that has begun. A date that
    doesn't exist gives null.
    """
    q = F.lower(question)
    epoch = F.lit("1970-01-01").cast("date")
    day = F.date_add(epoch, F.floor(now / _DAY).cast("int"))
    seconds = lambda d: F.datediff(d, epoch).cast("bigint") * _DAY
    year, month = F.year(day), F.month(day)

    iso = F.regexp_extract(q, "\\b(20\\d{2}-\\d{2}-\\d{2})\\b", 1)
    iso_start = seconds(iso.try_cast("date"))

    def named(lead: str) -> tuple[Column, Column, Column]:
        pattern = f"\\b{lead} {_MONTH}(?:\\s+(\\d{{4}}))?\\b"
        name = F.regexp_extract(q, pattern, 1)
        number = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")
        given = F.regexp_extract(q, pattern, 2).try_cast("int")
        y = F.coalesce(given, F.when(number <= month, year).otherwise(year - 1))
        first = F.when(number > 0, F.make_date(y, F.greatest(number, F.lit(1)), F.lit(1)))
        label = F.concat_ws(" ", F.element_at(F.array(*[F.lit(m.capitalize()) for m in MONTHS]), F.greatest(number, F.lit(1))), y.cast("string"))
        return name, first, label

    in_name, in_first, in_label = named("in")
    since_name, since_first, since_label = named("since")
    month_end = lambda first: seconds(F.add_months(first, 1)) - 1
    today = F.floor(now / _DAY) * _DAY
    this_month = F.trunc(day, "month")
    this_year = F.trunc(day, "year")
    night_end = today + 8 * 3600
    weekday = F.weekday(day)

    def closed(start: Column, end: Column, label: Column) -> Column:
        return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), label.alias("label")))

    return (
        F.when(iso != "", closed(iso_start, iso_start + _DAY - 1, iso))
        .when(in_name != "", closed(seconds(in_first), month_end(in_first), in_label))
        .when(since_name != "", closed(seconds(since_first), now, F.concat(F.lit("since "), since_label)))
        .when(q.rlike("\\blast night\\b"), closed(today - _DAY + 17 * 3600, night_end, F.lit("last night")))
        .when(q.rlike("\\byesterday\\b"), closed(today - _DAY, today - 1, F.lit("yesterday")))
        .when(q.rlike("\\btoday\\b"), closed(today, today + _DAY - 1, F.lit("today")))
        .when(q.rlike("\\bthis week\\b"), closed(today - weekday * _DAY, now, F.lit("this week")))
        .when(q.rlike("\\b(last|past) week\\b"), closed(now - 7 * _DAY, now, F.lit("last week")))
        .when(q.rlike("\\bthis month\\b"), closed(seconds(this_month), now, F.lit("this month")))
        .when(q.rlike("\\blast month\\b"), closed(seconds(F.add_months(this_month, -1)), seconds(this_month) - 1, F.lit("last month")))
        .when(q.rlike("\\bthis year\\b"), closed(seconds(this_year), now, F.lit("this year")))
        .when(q.rlike("\\blast year\\b"), closed(seconds(F.add_months(this_year, -12)), seconds(this_year) - 1, F.lit("last year")))
    )


def overlaps(start: Column, end: Column, ts_start: Column, ts_end: Column) -> Column:
    """Whether two closed intervals share a point."""
    return (ts_end >= start) & (ts_start <= end)


# ---------------------------------------------------------------- answers


def cited(answer: Column, n_hits: Column) -> Column:
    """The distinct numbers of the [W#] tags that name one of the hits, in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit("\\[W(\\d+)\\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= n_hits))))


def source_numbers(cited_numbers: Column, n_hits: Column, limit: int = 3) -> Column:
    """The first ``limit`` cited numbers, else those of the top hits."""
    top = F.when(n_hits > 0, F.sequence(F.lit(1), F.greatest(F.least(F.lit(limit), n_hits), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.slice(F.when(F.size(cited_numbers) > 0, cited_numbers).otherwise(top), 1, limit)


def context_block(hits: Column) -> Column:
    """Numbered excerpts of an array of hits (ts_start, speakers, text), for a prompt."""
    block = lambda h, i: F.concat(F.lit("[W"), (i + 1).cast("string"), F.lit("] "), utc_day(h["ts_start"]), F.lit(", "), h["speakers"], F.lit(":\n"), h["text"])
    return F.array_join(F.transform(hits, block), "\n\n")


def sources_block(hits: Column, cited_numbers: Column) -> Column:
    """A line per hit with its link, ticked where it was cited."""
    line = lambda h, i: F.concat(
        F.lit("[W"), (i + 1).cast("string"), F.lit("]"), F.when(F.array_contains(cited_numbers, i + 1), F.lit(" ✓")).otherwise(F.lit("")),
        F.lit(" "), utc_day(h["ts_start"]), F.lit(" · "), h["speakers"], F.lit(" · "), chat_link(h["chat_id"], h["first_msg"]),
    )
    return F.array_join(F.transform(hits, line), "\n")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def linked_answer(answer: Column, hits: Column) -> Column:
    """The answer for display: escaped, each [W#] of a hit turned into a link to its first message."""

    def link(text: Column, i: Column) -> Column:
        tag = F.concat(F.lit("[W"), i.cast("string"), F.lit("]"))
        h = F.element_at(hits, i)
        return F.replace(text, tag, F.concat(F.lit('<a href="'), chat_link(h["chat_id"], h["first_msg"]), F.lit('">'), tag, F.lit("</a>")))

    numbers = F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.size(hits))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, escape_html(answer), link)


def excerpt(text: Column, width: int = 600) -> Column:
    """One line of at most ``width`` characters, cut at a word; line breaks shown as a mark."""
    flat = F.trim(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ⏎ ")), "\\s+", " "))
    cut = F.regexp_extract(flat, f"^(.{{0,{width - 2}}})(?=\\s)", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(cut), F.lit(" …")))


# ---------------------------------------------------------------- budgets and messages


def estimated_tokens(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 1) / 2)).cast("bigint")


def completion_tokens(prompt_tokens: Column, wanted: Column, cap: Column, small_cap: int = 8000, small_completion: int = 2048, least: int = 256) -> Column:
    """What is left for a completion under a request cap (0: none); null where less than ``least`` is."""
    asked = F.when((cap > 0) & (cap <= small_cap), F.least(wanted, F.lit(small_completion))).otherwise(wanted)
    room = cap - prompt_tokens
    return F.when(cap <= 0, asked).when(room >= least, F.least(asked, room))


def retry_wait(detail: Column, most: float = 20.0) -> Column:
    """Seconds a busy service asks to wait, and a quarter; null where it doesn't, or for too long."""
    # fixed values: how services say it
    wait = F.regexp_extract(detail, "(?i)try again in (\\d+(?:\\.\\d+)?)\\s*s", 1).try_cast("double") + 0.25
    return F.when(wait <= most, wait)


def wait_text(seconds: Column) -> Column:
    """Under a minute in seconds, rounded up by one; else in minutes, rounded up."""
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.concat((whole + 1).cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor((whole + 59) / 60).cast("string"), F.lit(" min")))


def shortened(text: Column, most: int = 3500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def known_language(lang: Column, languages: tuple[str, ...] = ("ru", "en")) -> Column:
    """The language, or the first of the list where it is unknown."""
    return F.when(lang.isin(*languages), lang).otherwise(F.lit(languages[0]))


def next_language(lang: Column, languages: tuple[str, ...] = ("ru", "en")) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in languages]), known_language(lang, languages))
    return F.element_at(F.array(*[F.lit(x) for x in (*languages[1:], languages[0])]), at.cast("int"))


def translated(lang: Column, key: str, catalog: dict[str, dict[str, str]], **values: Column) -> Column:
    """The text of a key in a language of ``catalog`` ({lang: {key: text}}), with ``{name}`` filled in; an unknown language is the first."""
    languages = tuple(catalog)
    text = F.lit(catalog[languages[0]].get(key, key))
    for name in languages[1:]:
        text = F.when(known_language(lang, languages) == name, F.lit(catalog[name].get(key, catalog[languages[0]].get(key, key)))).otherwise(text)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def info_text(template: Column, updated: Column, source: Column, unknown: Column, stats: Column | None = None) -> Column:
    """A description with ``{updated}`` and ``{source}`` filled in, escaped for display, and the statistics below if there are any."""
    shown = F.when(updated == "unknown", unknown).otherwise(updated)
    text = F.replace(F.replace(template, F.lit("{updated}"), escape_html(shown)), F.lit("{source}"), escape_html(source))
    return text if stats is None else F.concat(text, F.coalesce(F.concat(F.lit("\n\n"), stats), F.lit("")))


def mentions(text: Column, username: Column) -> Column:
    return F.contains(F.lower(text), F.concat(F.lit("@"), F.lower(username)))


def without_mention(text: Column, username: Column) -> Column:
    """The text without ``@username`` in exactly that spelling."""
    return F.trim(F.replace(text, F.concat(F.lit("@"), username), F.lit("")))


def is_member(status: Column, still_in: Column) -> Column:
    return F.coalesce(status.isin("creator", "administrator", "member") | ((status == "restricted") & F.coalesce(still_in, F.lit(False))), F.lit(False))


def stats_text(messages: Column, windows: Column, embedded: Column, chats: Column, first: Column, last: Column) -> Column:
    """Table statistics in one line; the span is left out where there are no messages."""
    counts = F.concat(messages.cast("string"), F.lit(" messages in "), chats.cast("string"), F.lit(" chats, "), windows.cast("string"), F.lit(" windows, "), embedded.cast("string"), F.lit(" embedded"))
    return F.concat(counts, F.when(first.isNotNull() & last.isNotNull(), F.concat(F.lit("; "), first, F.lit(" to "), last)).otherwise(F.lit("")))


def error_report(level: Column, logger: Column, message: Column, trace: Column, most: int = 3500) -> Column:
    """Level, logger and message of a log record, its traceback below, cut to a length."""
    head = F.concat(level, F.lit(" "), logger, F.lit(": "), message)
    return shortened(F.concat_ws("\n\n", head, F.when(trace != "", trace)), most)
