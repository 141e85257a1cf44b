import random

import pytest

from chatloom.llm.conversations import conversation_texts, conversations


def brute(rows):
    cur = {}
    for r in rows:
        i, chat, msg, *_ = r
        if chat is not None and msg is not None and ((chat, msg) not in cur or cur[chat, msg][0] < i):
            cur[chat, msg] = r
    cur = {k: v for k, v in cur.items() if v[6] is not None and v[7] is not None}
    blank = lambda r: not (r[7] or "").strip()
    members, early = {}, set()
    for (chat, msg), r in cur.items():
        path, at = set(), msg
        while at is not None and (chat, at) in cur and at not in path:
            path.add(at)
            if cur[chat, at][3] is None:
                members.setdefault((chat, at), []).append(r)
                if r[3] is not None and r[6] < cur[chat, r[3]][6]:
                    early.add((chat, at))
                break
            at = cur[chat, at][3]
    out = set()
    for (chat, root), ms in members.items():
        o = cur[chat, root]
        if o[4] is None or blank(o) or (chat, root) in early or not any(m[2] != root and not blank(m) and m[4] is not None and m[4] != o[4] for m in ms):
            continue
        out |= {(chat, root, i, m[2]) for i, m in enumerate(sorted(ms, key=lambda m: (m[6], m[2])), 1)}
    return out


def of(df):
    return {(r.chat_id, r.root_msg, r.seq, r.msg_id) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_same_as_following_each_reply(messages_of, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        msg = rng.randint(1, 200)
        reply = rng.choice([None, None, rng.randint(1, 200), rng.randint(max(1, msg - 3), msg)])
        rows.append((i, 1 if rng.random() < 0.8 else 2, msg, reply, rng.choice([None, 1, 2, 3]), "s", msg if rng.random() < 0.97 else 0, rng.choice(["hi", "hi", "x\ny", " ", "  ", ""])))
    assert of(conversations(messages_of(rows))) == brute(rows)


def test_a_long_chain_a_ring_and_a_busy_root(messages_of):
    chain = [(i, 1, i, i - 1 if i > 1 else None, i % 2, "s", i, "t") for i in range(1, 300)]
    ring = [(1000 + i, 2, i, i % 5 + 1, i, "s", i, "t") for i in range(1, 6)] + [(1010, 2, 9, 9, 1, "s", 1, "self"), (1011, 2, 10, 77, 1, "s", 1, "to none")]
    busy = [(2000, 3, 1, None, 1, "s", 0, "q")] + [(2000 + i, 3, i, 1, 2, "s", i, "a") for i in range(2, 400)]
    rows = chain + ring + busy
    assert of(conversations(messages_of(rows))) == brute(rows)


def test_roles_edits_and_rejections(messages_of):
    rows = [
        (1, 1, 1, None, 5, "s", 0, "question?"), (2, 1, 2, 1, 6, "s", 1, "old"), (3, 1, 2, 1, 6, "s", 1, "new"), (4, 1, 3, 2, 5, "s", 2, "thanks"), (5, 1, 4, 1, None, "s", 3, "who am I"),
        (6, 1, 10, None, 5, "s", 0, "only mine"), (7, 1, 11, 10, 5, "s", 1, "me again"), (8, 1, 20, None, None, "s", 0, "no sender"), (9, 1, 21, 20, 6, "s", 1, "a"),
        (10, 1, 30, None, 5, "s", 0, "then blank"), (11, 1, 30, None, 5, "s", 0, "  \n"), (12, 1, 31, 30, 6, "s", 1, "a"), (13, 1, 40, None, 5, "s", 9, "late"), (14, 1, 41, 40, 6, "s", 8, "before it"),
        (15, 1, 50, None, 5, "s", 0, "q"), (16, 1, 51, 50, 6, "s", 1, None),
    ]
    got = conversation_texts(messages_of([(*r, "x", True) for r in rows], ", role string, blank boolean")).collect()
    assert [(r.seq, r.msg_id, r.role, r.text) for r in sorted(got, key=lambda r: (r.root_msg, r.seq))] == [(1, 1, "asker", "question?"), (2, 2, "answerer", "new"), (3, 3, "asker", "thanks"), (4, 4, "answerer", "who am I")]


def test_empty_and_nulls(messages_of):
    assert conversations(messages_of([])).collect() == []
    rows = [(1, None, 1, None, 1, "s", 0, "x"), (2, 1, None, None, 1, "s", 0, "x"), (3, 1, 1, None, 1, "s", None, "x"), (4, 1, 2, 1, 2, "s", 1, "x"), (None, 1, 5, None, None, None, 1, None)]
    assert conversations(messages_of(rows)).collect() == []


def test_deletes_are_folded_by_version(messages_of):
    rows = [
        (1, 1, 1, None, 1, "s", 1, "q"), (2, 1, 2, 1, 2, "s", 2, "a"), (3, 1, 3, 2, 1, "s", 3, "more"), (4, 1, 2, 1, 2, "s", 2, None),  # the answer is deleted: nothing is left
        (5, 2, 1, None, 1, "s", 1, None), (6, 2, 1, None, 1, "s", 1, "back"), (7, 2, 2, 1, 2, "s", 2, "a"),  # a delete is undone by a later version
        (9, 3, 1, None, 1, "s", 1, "q"), (10, 3, 2, 1, 2, "s", 2, "a"), (8, 3, 2, 1, 2, "s", 2, None),  # a delete that arrives late is an older version
    ]
    got = of(conversations(messages_of(rows)))
    assert got == brute(rows) == {(2, 1, 1, 1), (2, 1, 2, 2), (3, 1, 1, 1), (3, 1, 2, 2)}
