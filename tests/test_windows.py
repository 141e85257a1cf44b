import random

import pytest

from chatloom.operators.incremental import boundaries, plan_reindex, plan_update, rebuild, watermarks
from chatloom.operators.windows import WindowRules, build_windows, window_members, window_spans


def brute(rows, rules):
    """The windows of one chat, one message at a time."""
    out, cur, chars = [], [], 0
    for m in rows:
        if cur:
            old = m["ts"] - cur[-1]["ts"] > rules.gap and m["reply_to"] not in {c["msg_id"] for c in cur}
            if old or len(cur) >= rules.max_msgs or chars >= rules.max_chars:
                out.append(cur)
                cur = [] if old or not rules.overlap else cur[-rules.overlap :]
                chars = sum(len(c["text"]) for c in cur)
        cur = [*cur, m]
        chars += len(m["text"])
    return out + ([cur] if cur else [])


def make(seed, n, chats, silence):
    rng = random.Random(seed)
    out, t = [], {}
    for i in range(n):
        c = 1 if rng.random() < 0.7 else rng.randint(2, chats)
        t[c] = t.get(c, 0) + rng.choice([0, 1, 3, silence])
        out.append({"chat_id": c, "msg_id": i, "reply_to": rng.randint(max(0, i - 20), i) if rng.random() < 0.3 else None, "ts": t[c], "text": "x" * rng.choice([0, 1, 5, 30])})
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r["chat_id"], r["msg_id"], r["reply_to"], r.get("sender_id"), r.get("sender"), r["ts"], r["text"]) for r in rows], "chat_id bigint, msg_id bigint, reply_to bigint, sender_id bigint, sender string, ts bigint, text string")


@pytest.mark.parametrize(("seed", "silence", "rules"), [
    (1, 100, WindowRules(50, 6, 60, 2)), (2, 3, WindowRules(50, 6, 1000, 2)), (3, 3, WindowRules(50, 7, 40, 3)), (4, 60, WindowRules(50, 25, 1500, 0)),
])
def test_same_as_one_pass(spark, seed, silence, rules):
    rows = make(seed, 500, 3, silence)
    got = {(r.chat_id, r.first_msg, r.last_msg, r.ts_start, r.ts_end, r.n_msgs) for r in window_spans(window_members(frame(spark, rows), rules)).collect()}
    want = set()
    for c in {r["chat_id"] for r in rows}:
        mine = sorted((r for r in rows if r["chat_id"] == c), key=lambda r: (r["ts"], r["msg_id"]))
        want |= {(c, w[0]["msg_id"], w[-1]["msg_id"], w[0]["ts"], w[-1]["ts"], len(w)) for w in brute(mine, rules)}
    assert got == want


def test_rules_are_checked():
    with pytest.raises(ValueError):
        WindowRules(max_msgs=3, overlap=3)


def people(spark):
    return spark.createDataFrame([(1, "Anna"), (2, "")], "sender_id bigint, display_name string"), spark.createDataFrame([(2, 7)], "sender_id bigint, ordinal bigint")


def test_rendering(spark):
    rows = [
        {"chat_id": 1, "msg_id": 1, "reply_to": None, "ts": 0, "text": "hi\nthere", "sender_id": 1, "sender": "x"},
        {"chat_id": 1, "msg_id": 2, "reply_to": None, "ts": 60, "text": None, "sender_id": 2, "sender": "Private"},
        {"chat_id": 1, "msg_id": 3, "reply_to": None, "ts": 61, "text": "c", "sender_id": 3, "sender": None},
        {"chat_id": 1, "msg_id": 4, "reply_to": None, "ts": 62, "text": "d", "sender_id": None, "sender": "Ghost"},
    ]
    [w] = build_windows(frame(spark, rows), *people(spark)).collect()
    assert w.text == "[1970-01-01 00:00] Anna: hi\nthere\n[1970-01-01 00:01] User 7: \n[1970-01-01 00:01] User #3: c\n[1970-01-01 00:01] User unknown: d"
    assert w.speakers == "Anna, User #3, User 7, User unknown"
    [e] = build_windows(frame(spark, rows), *people(spark), mode="export").collect()
    assert e.speakers == "Anna, Ghost, Private, User #3"


def test_empty_and_null_keys(spark):
    assert window_members(frame(spark, [])).collect() == []
    odd = [{"chat_id": None, "msg_id": 1, "reply_to": None, "ts": 1, "text": "a"}, {"chat_id": 1, "msg_id": 1, "reply_to": None, "ts": None, "text": "a"}]
    assert window_members(frame(spark, odd)).collect() == []


def test_incremental_is_the_full_build(spark):
    """Short texts and no replies: a tail rebuilt from its first message gives what a full build gives."""
    rows = [{"chat_id": c, "msg_id": i, "reply_to": None, "ts": i + (5000 if i > 12 else 0), "text": "m", "sender_id": 1, "sender": "s"} for c in (1, 2) for i in range(1, 45)]
    early = frame(spark, [r for r in rows if r["msg_id"] <= 30])
    late = frame(spark, rows)
    who = people(spark)
    columns = ["chat_id", "first_msg", "last_msg", "ts_start", "ts_end", "speakers", "text"]
    first = rebuild(early, spark.createDataFrame([], "id bigint, chat_id bigint, first_msg bigint, last_msg bigint, ts_start bigint, ts_end bigint, speakers string, text string"), *who, plan_reindex(early))
    stored = first.selectExpr("xxhash64(chat_id, first_msg, last_msg) id", *columns)
    state = watermarks(early, plan_reindex(early), spark.createDataFrame([], "chat_id bigint, last_indexed_msg_id bigint"))
    plan = plan_update(late, stored, state)
    assert {r.chat_id for r in plan.collect()} == {1, 2}
    after = rebuild(late, stored, *who, plan)
    assert set(after.select(columns).collect()) == set(build_windows(late, *who).select(columns).collect())
    kept = after.where("id is not null").count()
    assert kept and kept < after.count()  # only the tail is new
    marks = watermarks(late, plan, state)
    assert {(r.chat_id, r.last_indexed_msg_id) for r in marks.collect()} == {(1, 44), (2, 44)}
    assert plan_update(late, after.withColumnRenamed("id", "id"), marks).collect() == []
    assert plan_update(late, after, marks, force=True).count() == 2


def test_lookback(spark):
    rows = [{"chat_id": 1, "msg_id": i, "reply_to": None, "ts": i * 86400, "text": "m"} for i in range(1, 41)]
    m = frame(spark, rows)
    w = window_spans(window_members(m)).withColumnRenamed("n_msgs", "id")
    [b] = boundaries(m, w, 14).collect()
    assert (b.tail, b.lookback, b.boundary) == (40, 26, 26)
