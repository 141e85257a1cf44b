from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chatloom.functions import parsing as P

NOW = int(datetime(2026, 8, 13, 15, 0, tzinfo=timezone.utc).timestamp())


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


def apply(spark, values, kind, fn):
    return [r.out for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(fn(F.col("x")).alias("out")).collect()]


PHRASES = [
    ("what about 2026-02-14?", at(2026, 2, 14), at(2026, 2, 14, 23, 59, 59), "2026-02-14"),
    ("in February", at(2026, 2, 1), at(2026, 2, 28, 23, 59, 59), "February 2026"),
    ("in sept 2024", at(2024, 9, 1), at(2024, 9, 30, 23, 59, 59), "September 2024"),
    ("in december", at(2025, 12, 1), at(2025, 12, 31, 23, 59, 59), "December 2025"),
    ("since May", at(2026, 5, 1), NOW, "since May 2026"),
    ("last night", at(2026, 8, 12, 17), at(2026, 8, 13, 8), "last night"),
    ("Yesterday", at(2026, 8, 12), at(2026, 8, 12, 23, 59, 59), "yesterday"),
    ("today", at(2026, 8, 13), at(2026, 8, 13, 23, 59, 59), "today"),
    ("this week", at(2026, 8, 10), NOW, "this week"),
    ("past week", NOW - 7 * 86400, NOW, "last week"),
    ("this month", at(2026, 8, 1), NOW, "this month"),
    ("last month", at(2026, 7, 1), at(2026, 7, 31, 23, 59, 59), "last month"),
    ("this year", at(2026, 1, 1), NOW, "this year"),
    ("last year", at(2025, 1, 1), at(2025, 12, 31, 23, 59, 59), "last year"),
]


def test_time_phrases(spark):
    got = apply(spark, [p[0] for p in PHRASES] + ["whenever", "inmay", None], "string", lambda c: P.time_range(c, F.lit(NOW)))
    assert [tuple(r) if r else None for r in got] == [p[1:] for p in PHRASES] + [None, None, None]
    assert apply(spark, ["on 2026-02-31"], "string", lambda c: P.time_range(c, F.lit(NOW))) == [None]
    january = at(2026, 1, 10)
    assert [r.label for r in apply(spark, ["last month", "in february"], "string", lambda c: P.time_range(c, F.lit(january)))] == ["last month", "February 2025"]


def test_chat_ids(spark):
    rows = spark.createDataFrame([(123, "private_supergroup"), (123, "private_group"), (123, "personal_chat"), (-5, "x"), (9, None), (7, "odd_channel")], "raw bigint, kind string")
    assert [r[0] for r in rows.select(P.live_chat_id(F.col("raw"), F.col("kind"))).collect()] == [-100123, -123, 123, -5, 9, -1007]
    assert apply(spark, [-1001234, -149, 5], "bigint", P.export_chat_ids) == [[1234], [149], []]
    assert apply(spark, [-5, 7], "bigint", P.candidate_chat_ids) == [[-5], [7, -1007, -7]]
    assert apply(spark, [" 12 ", "", "-7", None, "x"], "string", P.configured_chat_id) == [-10012, None, -7, None, None]
    assert apply(spark, ["user12a3", "channel", None], "string", P.sender_number) == [123, None, None]
    assert apply(spark, [-1001234, -149, 5], "bigint", lambda c: P.chat_link(c, F.lit(8))) == ["https://t.me/c/1234/8", "https://t.me/c/149/8", "https://t.me/c/5/8"]


def test_times(spark):
    rows = spark.createDataFrame([("12", "x"), ("oops", "2024-01-02T03:04:05"), (None, None), (None, "bad")], "u string, d string")
    assert [r[0] for r in rows.select(P.export_time(F.col("u"), F.col("d"))).collect()] == [12, at(2024, 1, 2, 3, 4, 5), None, None]
    assert apply(spark, [0, None], "bigint", P.utc_label) == ["1970-01-01 00:00 UTC", None]
    assert apply(spark, [2, -5, 99], "int", lambda c: P.display_time(F.lit(0).cast("bigint"), c)) == ["1970-01-01 02:00:00 UTC+02:00", "1969-12-31 19:00:00 UTC-05:00", "1970-01-01 02:00:00 UTC+02:00"]


@pytest.mark.parametrize(("question", "prior", "want"), [
    ("how much was it", "ski trip price", "ski trip price — follow-up: how much was it"), ("what about Nino?", "who paid", "who paid — follow-up: what about Nino?"),
    ("and when does the bus leave from the station", "x", "x — follow-up: and when does the bus leave from the station"), ("who booked the hotel for all of us", "x", "who booked the hotel for all of us"),
    ("  how much was it ", None, "how much was it"), ("", "x", ""), ("that one", " ", "that one"),
])
def test_follow_ups(spark, question, prior, want):
    df = spark.createDataFrame([(question, prior)], "q string, p string")
    assert df.select(P.standalone(F.col("q"), F.col("p"))).first()[0] == want


def test_forced_follow_up(spark):
    df = spark.createDataFrame([("who booked the hotel for all of us", "x")], "q string, p string")
    assert df.select(P.standalone(F.col("q"), F.col("p"), True)).first()[0] == "x — follow-up: who booked the hotel for all of us"


def test_whom_a_question_asks_about(spark):
    rows = [("what did Nino say about it", "Nino", True), ("Nino said so", "nino", True), ("according to A.B", "A.B", True), ("according to AxB", "A.B", False), ("nino is here", "Nino", False), ("что сказала Анна? Анна said", "анна", True), ("did Al say", "Al", False)]
    df = spark.createDataFrame(rows, "q string, n string, want boolean")
    assert all(r.got == r.want for r in df.select("want", P.asks_about(F.col("q"), F.col("n")).alias("got")).collect())


def test_citations_and_sources(spark):
    hit = "struct<chat_id:bigint,first_msg:bigint,ts_start:bigint,speakers:string,text:string>"
    df = spark.createDataFrame([("so [W2] and [W9] <b> [W2] [W1]", [(-100123, 5, 0, "A", "one"), (7, 6, 86400, "B", "two")]), ("none", [(7, 6, 0, "B", "two")]), ("[W1]", [])], f"a string, h array<{hit}>")
    n, c = F.size("h"), P.cited(F.col("a"), F.size("h"))
    rows = df.select(c.alias("c"), P.source_numbers(c, n).alias("s"), P.sources_block(F.col("h"), c).alias("b"), P.context_block(F.col("h")).alias("x"), P.linked_answer(F.col("a"), F.col("h")).alias("l")).collect()
    assert [(r.c, r.s) for r in rows] == [([1, 2], [1, 2]), ([], [1]), ([], [])]
    assert rows[0].b == "[W1] ✓ 1970-01-01 · A · https://t.me/c/123/5\n[W2] ✓ 1970-01-02 · B · https://t.me/c/7/6"
    assert rows[0].x == "[W1] 1970-01-01, A:\none\n\n[W2] 1970-01-02, B:\ntwo"
    assert rows[0].l == 'so <a href="https://t.me/c/7/6">[W2]</a> and [W9] &lt;b&gt; <a href="https://t.me/c/7/6">[W2]</a> <a href="https://t.me/c/123/5">[W1]</a>'


def test_budgets_and_messages(spark):
    assert apply(spark, ["", "abc", "ж"], "string", P.estimated_tokens) == [1, 2, 1]
    df = spark.createDataFrame([(100, 4096, 0), (100, 4096, 8000), (100, 4096, 9000), (7900, 4096, 8000)], "p bigint, w bigint, c bigint")
    assert [r[0] for r in df.select(P.completion_tokens(F.col("p"), F.col("w"), F.col("c"))).collect()] == [4096, 2048, 4096, None]
    assert apply(spark, ["try again in 1.5s", "Try again in 30 s", "no"], "string", P.retry_wait) == [1.75, None, None]
    assert apply(spark, [0.5, 59.9, 60.0, 61.0], "double", P.wait_text) == ["1 s", "60 s", "1 min", "2 min"]
    assert apply(spark, ["abcdef", "abc"], "string", lambda c: P.shortened(c, 5)) == ["abcd…", "abc"]
    assert apply(spark, ["en", "xx", None], "string", P.known_language) == ["en", "ru", "ru"]
    assert apply(spark, ["en", "ru", None], "string", P.next_language) == ["ru", "en", "en"]
    assert apply(spark, ["hi @Bot x", "hi"], "string", lambda c: P.mentions(c, F.lit("bot"))) == [True, False]
    assert apply(spark, ["hi @bot", "hi @Bot"], "string", lambda c: P.without_mention(c, F.lit("bot"))) == ["hi", "hi @Bot"]
    df = spark.createDataFrame([("member", None), ("restricted", True), ("restricted", None), ("left", True), (None, None)], "s string, m boolean")
    assert [r[0] for r in df.select(P.is_member(F.col("s"), F.col("m"))).collect()] == [True, True, False, False, False]
    long = apply(spark, ["word " * 300, "a\nb"], "string", P.excerpt)
    assert len(long[0]) <= 600 and long[0].endswith("word …") and long[1] == "a ⏎ b"
