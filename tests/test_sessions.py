import random

import pytest

from chatloom.operators.ordered import rank_in_groups
from chatloom.operators.sessions import cut_tree, gap_tree, sessions


def brute(rows, gap, carry=True):
    current = {}
    for i, chat, msg, reply, _, _, ts, _ in rows:
        if None in (chat, msg, ts):
            continue
        if (chat, msg) not in current or current[chat, msg][0] < i:
            current[chat, msg] = (i, ts, reply)
    out, state = set(), {}
    for chat, ts, msg, reply in sorted(((c, t, m, r) for (c, m), (_, t, r) in current.items()), key=lambda x: x[:3]):
        s = state.get(chat)
        if s is None or (ts - s["last"] > gap and not (carry and reply in s["ids"])):
            if s:
                out.add((chat, s["first"], s["msg"], s["n"]))
            s = state[chat] = {"first": msg, "ids": set(), "n": 0}
        s.update(last=ts, msg=msg, n=s["n"] + 1)
        s["ids"].add(msg)
    out |= {(c, s["first"], s["msg"], s["n"]) for c, s in state.items()}
    return out


def stream(seed, n=400, chats=3, hot=0.7, reply=0.4, spread=40):
    rng = random.Random(seed)
    rows, ids, t = [], {}, {}
    for i in range(n):
        c = 1 if rng.random() < hot else rng.randint(2, chats)
        t[c] = t.get(c, 0) + rng.choice([0, 1, 5, spread, spread * 3])
        msg = rng.randint(1, n * 3)
        known = ids.setdefault(c, [])
        r = rng.choice([*known[-6:], rng.choice(known)]) if known and rng.random() < reply else (rng.randint(1, 9) if rng.random() < 0.05 else None)
        known.append(msg)
        rows.append((i, c, msg, r, 1, "a", t[c], "x"))
    return rows


def of(df):
    return {(r.chat_id, r.first_msg, r.last_msg, r.messages) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_same_as_one_pass(messages_of, seed):
    rows = stream(seed, reply=[0.1, 0.5, 0.9, 1.0][seed])
    seen, unique = set(), []
    for r in rows:  # one version of each message, so that the sequential model is the definition
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            unique.append(r)
    assert of(sessions(messages_of(unique), 40)) == brute(unique, 40)
    assert of(sessions(messages_of(unique), 40, carry_replies=False)) == brute(unique, 40, carry=False)


def test_one_tree_for_many_gaps(spark, messages_of):
    rows = [r for r in stream(9, n=200)]
    first = {}
    for r in rows:
        first.setdefault((r[1], r[2]), r)
    rows = list(first.values())
    events = messages_of(rows).selectExpr("chat_id entity", "ts", "msg_id id", "cast(null as bigint) ref")
    tree = gap_tree(events)
    for gap in (0, 1, 5, 40, 1000):
        got = {(r.entity, r.first_id, r.last_id, r.n) for r in cut_tree(tree, gap).collect()}
        assert got == brute(rows, gap, carry=False)


def test_rules_at_the_edge(messages_of):
    rows = [
        (1, 1, 10, None, None, None, 0, None),
        (2, 1, 11, None, None, None, 1800, ""),  # exactly the gap: same session
        (3, 1, 12, 12, None, None, 3601, "x"),  # answers itself: new
        (4, 1, 13, 12, None, None, 9000, "x"),  # carried
        (5, 1, 14, 10, None, None, 19000, "x"),  # answers a message of another session: new
        (6, 1, 15, 99, None, None, 29000, "x"),  # answers nothing: new
        (7, 1, 15, 99, None, None, 29000, "again"),  # a repeated delivery
        (8, None, 1, None, None, None, 5, "x"),
        (9, 1, None, None, None, None, 5, "x"),
        (10, 1, 99, None, None, None, None, "x"),
    ]
    assert of(sessions(messages_of([(*r, 7) for r in rows], ", n bigint"), 1800)) == {(1, 10, 11, 2), (1, 12, 13, 2), (1, 14, 14, 1), (1, 15, 15, 1)}


def test_empty(messages_of):
    assert sessions(messages_of([])).collect() == []


def test_ties_in_time_go_by_id(messages_of):
    rows = [(i, 1, m, None, 1, "a", 5, "x") for i, m in enumerate([5, 3, 9])]
    assert of(sessions(messages_of(rows), 10)) == {(1, 3, 9, 3)}


def test_rank_in_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i * 7 % 501) for i in range(501)]
    got = {(r.k, r.o): r.seq for r in rank_in_groups(spark.createDataFrame(rows, "k bigint, o bigint"), ["k"], ["o"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {(k, o): i for i, o in enumerate(sorted(o for kk, o in rows if kk == k), 1)}
    assert got == want


@pytest.mark.parametrize("gap", [0, 100, 1800, 1801, 2000])
def test_equal_gaps_leave_few_open_nodes(messages_of, monkeypatch, gap):
    """A hot chat with one interval between all messages, over many chunks."""
    from chatloom.operators import sessions as S

    monkeypatch.setattr(S, "CHUNK_ROWS", 40)
    rows = [(i, 1, i, None, 1, "s", i * gap, "x") for i in range(400)] + [(1000 + i, 2, i, None, 1, "s", i * 7000 + (i % 3) * 900, "x") for i in range(90)]
    m = messages_of(rows)
    got = {(r.chat_id, r.first_msg, r.last_msg, r.messages) for r in S.sessions(m).collect()}
    want = set()
    for chat in (1, 2):
        mine = sorted((r[6], r[2]) for r in rows if r[1] == chat)
        run = [mine[0]]
        for a, b in zip(mine, mine[1:]):
            if b[0] - a[0] > 1800:
                want.add((chat, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(b)
        want.add((chat, run[0][1], run[-1][1], len(run)))
    assert got == want
    run = S._grow(*(S.np.arange(50, dtype=S.np.int64) * k for k in (gap, 1, 0)))
    assert S._can_matter(run, 1800).sum() <= 54 and (gap > 1800 or S._can_matter(run, 1800).sum() <= 1)
