import random
import tracemalloc
from collections import Counter
from datetime import datetime, timezone

import pytest

from chatloom.llm import splitting as S

WINDOWS = "id bigint, chat_id bigint, first_msg bigint, last_msg bigint, ts_start bigint, ts_end bigint, speakers string, text string"


def line(ts, who, text):
    return f"[{datetime.fromtimestamp(ts, timezone.utc):%Y-%m-%d %H:%M}] {who}: {text}"


def check(text, pieces, limit=2000, overlap=(100, 200)):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert 0 < b - a <= limit
    for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert overlap[0] <= b - c <= overlap[1]


@pytest.mark.parametrize("seed", range(6))
def test_any_text_is_covered(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéжя") for _ in range(rng.randint(1, 12)))
    joiner = [" ", ". ", "\n", "", " ", "! "][seed]
    text = joiner.join(word() for _ in range(1500))
    check(text, S.split(text, []))
    check(text, S.split(text, [], 400, (20, 60)), 400, (20, 60))


def test_a_cut_at_the_change_of_topic():
    boats = "The boat crossed the harbour. Sails and masts filled the harbour. " * 11
    bread = "Bakers knead the dough at dawn. Flour and yeast raise the bread. " * 12
    text = boats + bread
    pieces = S.split(text, [], 1000)
    assert any(abs(b - len(boats)) <= 40 and kind == "sentence" for _, b, kind in pieces)


def test_marks_are_not_torn_off():
    text = "é" * 3000
    for _, b, kind in S.split(text, [])[:-1]:
        assert kind == "none" and text[b] == "e"


def test_bad_overlap():
    with pytest.raises(ValueError):
        S.split("x" * 100, [], 50, (10, 40))


def frames(spark, turns, window_texts, first, last):
    messages = [(i, 1, m, None, 1, "s", ts, text) for i, (m, ts, text) in enumerate(turns)]
    ts = {m: t for m, t, _ in turns}
    windows = [(k, 1, first, last, ts[first], ts[last], "A", w) for k, w in enumerate(window_texts, 1)]
    return spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(messages, "id bigint, chat_id bigint, msg_id bigint, reply_to bigint, sender_id bigint, sender string, ts bigint, text string")


def test_pasted_transcripts_belong_to_their_message(spark):
    pasted = "see:\n" + "\n".join(line(60 * i, "Bo", "something said at length " * 4) for i in range(1, 30))
    turns = [(1, 60, "short"), (2, 120, pasted), (3, 180, "end")]
    text = "\n".join(line(ts, "A: b", t) for _, ts, t in turns)
    w, m = frames(spark, turns, [text], 1, 3)
    rows = S.oversized_pieces(w, m).orderBy("piece").collect()
    assert {r.cut for r in rows} == {"inside"} and rows[0].first_msg == 1 and rows[-1].last_msg == 3
    many = [(i, 60 * i, "words " * 12) for i in range(1, 60)]
    text = "\n".join(line(ts, "A", t) for _, ts, t in many)
    w, m = frames(spark, many, [text], 1, 59)
    rows = S.oversized_pieces(w, m).orderBy("piece").collect()
    assert {r.cut for r in rows} == {"between"} and all(r.boundary == "message" for r in rows[:-1])
    assert "".join(text[r.first_char : r.last_char + 1] == r.text and "y" or "n" for r in rows) == "y" * len(rows)
    covered = [(r.first_msg, r.last_msg) for r in rows]
    assert covered[0][0] == 1 and covered[-1][1] == 59 and all(b[0] <= a[1] <= b[1] for a, b in zip(covered, covered[1:]))


def test_outdated_unknown_and_missing_messages(spark):
    long = "y" * 1990
    turns = [(1, 60, "old text"), (1, 60, "new text"), (2, 120, long), (3, 180, "z")]
    shown = "\n".join([line(60, "A", "old text"), line(120, "A", long), line(180, "A", "z")])
    edited = "\n".join([line(60, "A", "never stored"), line(120, "A", long), line(180, "A", "z")])
    w, m = frames(spark, turns, [shown, edited, None, "short"], 1, 3)
    got = {(r.window_id, r.cut) for r in S.oversized_pieces(w, m).collect()}
    assert got == {(1, "inside"), (2, "inside")}
    alone = {(r.window_id, r.cut, r.first_msg, r.last_msg) for r in S.oversized_pieces(w, m.where("false")).where("piece = 1").collect()}
    assert alone == {(1, "inside", 1, 3), (2, "inside", 1, 3)}
    assert S.oversized_pieces(w.where("false"), m).collect() == []


def test_exactly_the_limit(spark):
    head = len(line(60, "A", ""))
    for size, cut in ((2000, "between"), (2001, "inside")):
        turns = [(1, 60, "x" * (size - head)), (2, 120, "tail")]
        w, m = frames(spark, turns, ["\n".join(line(ts, "A", t) for _, ts, t in turns)], 1, 2)
        assert {r.cut for r in S.oversized_pieces(w, m).collect()} == {cut}


def test_the_hash_is_sparks(spark):
    texts = ["", "a", "жя🙂", "x" * 1000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()
    assert all(S.hash_of(r.t) == r.h for r in rows)


def test_nulls_and_clashing_columns(spark):
    w = spark.createDataFrame([(1, None, None, None, None, None, None, "z " * 1500, 1, 2), (None, 1, 1, 1, 1, 1, "", "z " * 1500, 1, 2)], WINDOWS + ", window_id bigint, minute int")
    m = spark.createDataFrame([(None,) * 8], "id bigint, chat_id bigint, msg_id bigint, reply_to bigint, sender_id bigint, sender string, ts bigint, text string")
    rows = S.oversized_pieces(w, m).collect()
    assert {r.window_id for r in rows} == {1} and {r.cut for r in rows} == {"inside"} and rows[0].first_msg is None


def dense(text, gaps, block=S.BLOCK):
    """The depths by their definition."""
    edges = [0, *gaps, len(text)]
    units = [Counter(S._WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])]
    sims = []
    for i in range(1, len(units)):
        left, right = sum(units[max(0, i - block) : i], Counter()), sum(units[i : i + block], Counter())
        norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        sims.append(sum(n * right[w] for w, n in left.items()) / norm if norm else 0.0)

    def peak(xs, i):
        while i and xs[i - 1] >= xs[i] - 1e-12:
            i -= 1
        return xs[i]

    n = len(sims)
    return [peak(sims, i) + peak(sims[::-1], n - 1 - i) - 2 * s for i, s in enumerate(sims)]


@pytest.mark.parametrize("seed", range(4))
def test_depths_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 4))) for _ in range(30)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(rng.choice([3, 40, 600])))
    gaps = sorted({m.end() for m in S._SENTENCE.finditer(text)} - {len(text)})
    assert list(S.depths(text, gaps)) == pytest.approx(dense(text, gaps), abs=1e-9)


def test_two_million_characters_in_little_memory():
    text = " ".join(f"w{i % 977}x{i % 13} of{i}. Th\n" for i in range(110_000))
    assert len(text) > 2_000_000
    tracemalloc.start()
    check(text, S.split(text, []))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_a_long_label_is_a_label(spark):
    turns = [(1, 60, "x" * 1500), (2, 120, "y" * 1500)]
    text = "\n".join(line(ts, "A: " * 150 + "b", t) for _, ts, t in turns)
    w, m = frames(spark, turns, [text], 1, 2)
    assert {r.cut for r in S.oversized_pieces(w, m).collect()} == {"between"}
