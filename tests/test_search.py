import sqlite3

import numpy as np
import pytest

from chatloom.operators import search

TEXTS = [
    "The ski trip costs 200 lari each", "wifi password is HappyMonday2024", "foo_bar is a name, foo bar too", "bar foo in the wrong order", "naïve Å café",
    "Кто взял ключ? ключ у Анны", "the the the the", "", "trip trip trip to the lake", "x² and ½ of it", None,
] + [f"the usual message number {i}" for i in range(30)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(1 + i % 2, i, t) for i, t in enumerate(TEXTS)], "chat_id bigint, msg_id bigint, text string")


def test_bm25_is_fts5(spark, corpus):
    """An independent implementation of the same ranking."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, tokenize='unicode61')")
    for i, t in enumerate(TEXTS):
        db.execute("insert into f(rowid, text) values (?, ?)", (i, t or ""))
    for question in ["ski trip", "foo_bar", "password happymonday2024", "ключ Анны", "cafe naive", "trip trip lake"]:
        q = spark.createDataFrame([(1, question)], "qid bigint, question string")
        got = {r.msg_id: r.score for r in search.bm25(q, corpus).collect()}
        match = " OR ".join(f'"{t}"' for t in question.lower().split())
        want = {i: -s for i, s in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}
        assert got.keys() == want.keys()
        for k in got:
            assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_common_words_are_dropped_unless_all_are(spark, corpus):
    ask = lambda q: search.informative(
        p := search.question_phrases(spark.createDataFrame([(1, q)], "qid bigint, question string")), search.phrase_matches(p, search.postings(corpus)), search.corpus_size(corpus)
    )
    assert {r.token for r in ask("the usual password").collect()} == {"password"}
    assert {r.token for r in ask("the usual").collect()} == {"the", "usual"}
    assert ask('" OR ( a').count() == 1  # "or": single letters and signs are no tokens
    assert ask("").count() == 0


def test_chats_limit_before_the_cut(spark, corpus):
    q = spark.createDataFrame([(1, "trip", [2]), (2, "trip", None), (3, "trip", [])], "qid bigint, question string, chats array<bigint>")
    got = {(r.qid, r.chat_id) for r in search.bm25(q, corpus, chats="chats").collect()}
    assert got == {(2, 1)} or got == {(2, 1), (2, 2), (1, 2)}
    assert not any(k == 3 for k, _ in got)


def test_interval_join(spark):
    points = spark.createDataFrame([(1, p) for p in range(0, 300, 7)], "k bigint, p bigint")
    spans = spark.createDataFrame([(1, 10, 200, "a"), (1, 50, 50, "b"), (1, 90, 20, "never"), (2, 0, 300, "other"), (1, None, 5, "null")], "k bigint, lo bigint, hi bigint, n string")
    got = {(r.p, r.n) for r in search.interval_join(points, spans, "k", "p", "lo", "hi", 16).collect()}
    assert got == {(p, "a") for p in range(0, 300, 7) if 10 <= p <= 200}


def test_knn_and_fusion(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 8))
    v = spark.createDataFrame([(i, r.tolist(), i % 3, i, i + 5) for i, r in enumerate(x)], "window_id bigint, vec array<float>, chat_id bigint, ts_start bigint, ts_end bigint")
    q = spark.createDataFrame([(1, x[0].tolist(), None, None, None), (2, x[1].tolist(), [1], 10, 20), (3, x[2].tolist(), [], None, None)], "qid bigint, vec array<float>, chats array<bigint>, start bigint, end bigint")
    got = search.knn(q, v, 4, 8, ["chats", "start", "end"]).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(u @ u[0]))[:4].tolist()
    assert [r.window_id for r in sorted((r for r in got if r.qid == 1), key=lambda r: r.rank)] == order
    assert all(r.window_id % 3 == 1 and r.window_id + 5 >= 10 and r.window_id <= 20 for r in got if r.qid == 2)
    assert not [r for r in got if r.qid == 3]
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "qid bigint, window_id bigint, rank int")
    b = spark.createDataFrame([(1, 6, 1)], "qid bigint, window_id bigint, rank int")
    scores = {r.window_id: r.score for r in search.fuse(a, b).collect()}
    assert scores[6] == pytest.approx(0.7 / 22 + 1 / 21) and scores[5] == pytest.approx(0.7 / 21)


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    assert [r.window_id for r in search.usable_vectors(spark.createDataFrame(rows, "window_id bigint, vec array<float>"), 2).collect()] == [1]


def test_hybrid_filters_and_success(spark, corpus):
    w = spark.createDataFrame([(1, 1, 0, 8, 0, 10, "Anna", TEXTS[0]), (2, 2, 1, 9, 50, 60, "Joanna, Bob", TEXTS[1]), (3, 1, 10, 40, 5, 90, None, "rest")], "id bigint, chat_id bigint, first_msg bigint, last_msg bigint, ts_start bigint, ts_end bigint, speakers string, text string")
    v = search.encode_texts(w.select(w["id"].alias("window_id"), "text"), 16).select("window_id", "vec")
    q = spark.createDataFrame([(1, "ski trip", None, None, None, None), (2, "wifi password", [2], None, None, None), (3, "ski trip", None, 55, 100, None), (4, "trip", None, None, None, "ANNA")], "qid bigint, question string, chats array<bigint>, start bigint, end bigint, speaker string")
    q = search.encode_texts(q, 16, "question")
    hits = search.hybrid_search(q, corpus, w, v, dim=16).collect()
    by = lambda k: {r.window_id for r in hits if r.qid == k}
    assert by(2) == {2} and 1 in by(1) and 1 not in by(3) and by(4) <= {1, 2}
    cases = spark.createDataFrame([(1, ["200", "LARI"]), (2, ["HappyMonday2024", "nowhere"]), (9, ["x"])], "qid bigint, needles array<string>")
    results = search.success_at_k(spark.createDataFrame(hits), cases)
    assert {(r.qid, r.hit) for r in results.collect()} == {(1, True), (2, False), (9, False)}
    assert search.recall(results).first().recall == pytest.approx(1 / 3)
    assert search.recall(results.where("false")).first().recall == 0.0


def test_pack_and_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "vec array<float>")
    rows = df.select(search.unpack(search.pack(df["vec"])).alias("v"), search.dot(df["vec"], df["vec"]).alias("d")).collect()
    assert rows[0].v == [1.0, 2.0] and rows[0].d == 5.0 and rows[1].v is None and rows[1].d is None


def test_answers(spark):
    from chatloom.operators.answers import NOT_FOUND, answer, log_rows

    questions = spark.createDataFrame([(1, "who?"), (2, "nothing"), (3, "cite none")], "qid bigint, question string")
    hits = spark.createDataFrame([(1, 1, 10, -1005, 7, 0, "Ann", "one"), (1, 2, 11, 5, 8, 0, "Bo", "two"), (3, 1, 10, -1005, 7, 0, "Ann", "one")], "qid bigint, rank int, window_id bigint, chat_id bigint, first_msg bigint, ts_start bigint, speakers string, text string")

    def make():
        return lambda system, prompt: "Bo <says> so [W2] [W7]" if "who?" in prompt and "[W2] 1970-01-01, Bo:\ntwo" in prompt else "plain"

    rows = {r.qid: r for r in answer(questions, hits, make, "m").collect()}
    assert rows[1].cited_ids == [11] and rows[1].window_ids == [10, 11] and "&lt;says&gt;" in rows[1].display and rows[1].source_numbers == [2]
    assert rows[2].answer == NOT_FOUND and rows[2].window_ids == [] and rows[2].sources == ""
    assert rows[3].cited_ids == [] and rows[3].source_numbers == [1]
    log = log_rows(answer(questions, hits, make, "m"), 5, [1]).collect()
    assert {r.model for r in log} == {"m"} and log[0].chat_ids == [1]


def test_postings_follow_edits(spark):
    old = spark.createDataFrame([(1, 1, "a b"), (1, 2, "b c")], "chat_id bigint, msg_id bigint, text string")
    new = spark.createDataFrame([(1, 2, "d"), (1, 3, "a a")], "chat_id bigint, msg_id bigint, text string")
    got = {(r.term, r.msg_id, r.tf) for r in search.refresh_postings(search.postings(old), new).collect()}
    assert got == {("a", 1, 1), ("b", 1, 1), ("d", 2, 1), ("a", 3, 2)}


@pytest.mark.parametrize(("chunk", "held", "few"), [(1_000_000, 4_000_000, 200_000), (40, 30, 0), (7, 1, 200_000)])
def test_the_best_are_those_of_all_scores(spark, monkeypatch, chunk, held, few):
    rng = np.random.default_rng(chunk)
    for name, value in (("CHUNK_ROWS", chunk), ("HELD", held), ("FEW_TOKENS", few), ("BLOCK", 256 if held > 1 else 2)):
        monkeypatch.setattr(search, name, value)
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr_st", "_ab", "ab_ab_cd"]
    say = lambda n: " ".join(rng.choice(words, n, p=np.array([20, 12, 8, 6, 4, 3, 2, 1, 2, 1, 1]) / 60))
    docs = spark.createDataFrame([(i % 3, i // 3, say(rng.integers(0, 12)).replace("_", " ")) for i in range(240)], "chat_id bigint, msg_id bigint, text string")
    asked = [(i, say(4), [None, [0], [1, 2], []][i % 4]) for i in range(12)]
    q = spark.createDataFrame([*asked, (50, "nothing here", None), (51, None, None), (52, "", [1])], "qid bigint, question string, chats array<bigint>")
    for chats in (None, "chats"):
        want: dict = {}
        for r in search.bm25(q, docs, chats=chats).collect():
            want.setdefault(r.qid, []).append((-round(r.score, 9), r.chat_id, r.msg_id))
        got: dict = {}
        for r in search.bm25_top(q, docs, 5, chats=chats).collect():
            got.setdefault(r.qid, []).append((r.rank, -round(r.score, 9), r.chat_id, r.msg_id))
        assert {k: sorted(v)[:5] for k, v in want.items()} == {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    assert search.bm25_top(q.where("false"), docs, 5).collect() == [] and search.bm25_top(q, docs.where("false"), 5).collect() == []
    size = search.kept_size(docs, search.postings(docs)).first()
    plain = search.corpus_size(docs).first()
    assert size.n == plain.n and size.avg_length == pytest.approx(plain.avg_length)


def test_wide_intervals_take_few_buckets(spark):
    points = spark.createDataFrame([(1, p) for p in (-(10**17), -5, 0, 7, 10**6, 10**10, 10**17)], "k bigint, p bigint")
    spans = [(1, -(10**17), 10**17, "all"), (1, 0, 10**10, "wide"), (1, 5, 9, "small"), (1, -6, -5, "neg"), (1, 10**17, 10**17, "one")]
    got = {(r.p, r.n) for r in search.interval_join(points, spark.createDataFrame(spans, "k bigint, lo bigint, hi bigint, n string"), "k", "p", "lo", "hi", 16).collect()}
    want = {(p, n) for p in (-(10**17), -5, 0, 7, 10**6, 10**10, 10**17) for _, lo, hi, n in spans if lo <= p <= hi}
    assert got == want
    assert search.interval_join(points, spark.createDataFrame([], "k bigint, lo bigint, hi bigint, n string"), "k", "p", "lo", "hi").collect() == []


def test_folding_is_that_of_the_full_text_index(spark):
    from pyspark.sql import functions as F

    from chatloom.functions.parsing import document_terms

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    db.execute("create virtual table v using fts5vocab(f, 'row')")
    letters = [chr(c) for c in (*range(0xC0, 0x17F), *range(0x1CD, 0x1DD), 0x1D5, 0x1D6, *range(0x1E00, 0x1EFA)) if chr(c).isalpha() and c not in (0x130, 0x149, 0x1E9E)]
    texts = [f"a{ch}b" for ch in letters] + ["tấn", "cafés", "ǖa", "naïve", "ếa", "Ещё", "йод", "άλφα"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string").select("i", document_terms(F.col("t")).alias("terms")).collect()
    got = {r.i: r.terms for r in rows}
    for i, t in enumerate(texts):
        db.execute("delete from f")
        db.execute("insert into f values (?)", (t,))
        assert got[i] == [r[0] for r in db.execute("select term from v")], (t, got[i])


def test_people(spark):
    from chatloom.operators import people as P

    names = spark.createDataFrame([("Bea",), ("abe",), ("Ann Lee",), ("Bo",), (None,), ("",)], "display_name string")
    texts = spark.createDataFrame([(1, "what did bea say, and what did ABE say?"), (2, "from ann lee or from bea"), (3, "bea is here"), (4, None), (5, "did bo say so")], "id bigint, text string")
    assert {r.id: r.speaker for r in P.asked_speakers(texts, names).collect()} == {1: "abe", 2: "Ann Lee"}
    m = spark.createDataFrame([(1, "Private"), (2, None), (2, "")], "sender_id bigint, sender string")
    shown = spark.createDataFrame([(1, "Ann", "manual"), (3, "", "api")], "sender_id bigint, display_name string, source string")
    assert {r[0] for r in P.known_names(shown, m).collect()} == {"Ann"} and {r[0] for r in P.known_names(shown, m, "export").collect()} == {"Ann", "Private"}
    r = P.people_counts(m, shown).first()
    assert (r.senders, r.resolved, r.unresolved, r.by_source) == (2, 2, 0, {"api": 1, "manual": 1})
    requests = spark.createDataFrame([(5, 1, True), (6, 1, True), (1, 1, False), (2, 2, False), (3, 3, False)], "chat_id bigint, user_id bigint, is_group boolean")
    members = spark.createDataFrame([(1, True), (2, None), (3, False)], "user_id bigint, member boolean")
    assert {(r.chat_id, r.user_id) for r in P.allowed_requests(requests, members, 5).collect()} == {(5, 1), (1, 1)}
    offered = P.commands_for(spark.createDataFrame([("ask", False), ("reindex", True)], "command string, admin_only boolean"), members, spark.createDataFrame([(2,)], "user_id bigint"))
    assert {(r.user_id, r.command) for r in offered.collect()} == {(1, "ask"), (2, "ask"), (2, "reindex"), (3, "ask")}
    template = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "sender_id bigint, messages bigint")
    assert [r.sender_id for r in P.busiest_first(template).collect()] == [2, 3, 1] and [r.place for r in P.busiest_first(template, 2).collect()] == [1, 2]


def test_texts_of_the_interface(spark):
    from pyspark.sql import functions as F

    from chatloom.functions import parsing as P

    catalog = {"ru": {"hi": "привет {name}"}, "en": {"hi": "hello {name}"}}
    rows = spark.createDataFrame([("en",), ("de",), (None,)], "lang string").select(P.translated(F.col("lang"), "hi", catalog, name=F.lit("Bo")).alias("t")).collect()
    assert [r.t for r in rows] == ["hello Bo", "привет Bo", "привет Bo"]
    info = spark.range(1).select(
        P.info_text(F.lit("at {updated} from {source}"), F.lit("unknown"), F.lit("<x>"), F.lit("n/a"), F.lit("5 messages")).alias("a"),
        P.info_text(F.lit("at {updated}"), F.lit("1 < 2"), F.lit(""), F.lit("n/a"), F.lit(None).cast("string")).alias("b"),
    ).first()
    assert info.a == "at n/a from &lt;x&gt;\n\n5 messages" and info.b == "at 1 &lt; 2"
