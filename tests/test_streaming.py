import pytest

from chatloom.operators.windows import WindowRules, build_windows
from chatloom.streaming import live as L

COLUMNS = ["chat_id", "first_msg", "last_msg", "ts_start", "ts_end", "speakers", "text"]


def rows(lo, hi, chat=-100149, text="m"):
    return [(i, chat, i, None, 7, "Seven", i * 10, f"{text}{i}") for i in range(lo, hi)]


def put(spark, folder, data):
    spark.createDataFrame(data, L.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, live = tmp_path / "in", L.VersionedStore(spark, str(tmp_path / "store"))
    live.write({"messages": spark.createDataFrame([(None, 149, 1, None, 7, "Seven", 10, "exported")], L.MESSAGE_SCHEMA)})
    put(spark, source, rows(1, 31))

    def run():
        stream = spark.readStream.schema(L.MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = L.start_ingest(stream, live, str(tmp_path / "checkpoint"), every=20, available_now=True)
        assert q.awaitTermination(180)
        assert q.exception() is None

    run()
    assert live.read("messages").where("chat_id = 149").count() == 0  # adopted by the live id
    first = live.read("windows").count()
    assert first == 2
    put(spark, source, [*rows(31, 36), (99, -100149, 30, None, 7, "Seven", 300, "edited")])
    run()
    assert live.read("windows").count() == first  # five new messages are not enough
    L.flush(live)  # before a search
    messages, people, aliases = live.read("messages"), live.read("people"), live.read("aliases")
    assert messages.where("msg_id = 30").first().text == "edited" and messages.count() == 35
    assert {(r.sender_id, r.display_name) for r in people.collect()} == {(7, "Seven")} and aliases.first().ordinal == 1
    want = set(build_windows(messages, people, aliases).select(COLUMNS).collect())
    assert set(live.read("windows").select(COLUMNS).collect()) == want
    assert live.read("state").first().last_indexed_msg_id == 35
    before = live.manifest()
    L.absorb(live, spark.createDataFrame(rows(1, 3), L.MESSAGE_SCHEMA), live.last_batch())
    assert live.manifest() == before  # a batch that was written already
    assert L.flush(live) == {"chats": 0, "windows": 0} and live.manifest() == before  # nothing is new
    ids = {r.id for r in live.read("windows").collect()}
    assert {r.window_id for r in live.read("vectors").collect()} == ids and ids
    L.reindex(live, WindowRules(max_msgs=10))
    assert live.read("windows").count() > first
    L.flush(live, chats=[])
    assert live.read("state").first().last_indexed_msg_id == 35


@pytest.mark.parametrize(("processor", "schema", "batch"), [
    (L.CooldownProcessor(10), L.ACCEPTED, "cooldown"), (L.QuotaProcessor(2, 30), L.ACCEPTED, "quota"),
])
def test_state_over_batches_is_one_fold(spark, tmp_path, processor, schema, batch):
    from chatloom.operators import limits

    data = [(1 + i % 2, (i * 7) // 2, i, "text", "x") for i in range(40)]
    source = tmp_path / "in"
    kinds = "key bigint, t bigint, id bigint, kind string, text string"
    for lo in (0, 20):
        spark.createDataFrame(data[lo : lo + 20], kinds).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kinds).parquet(str(source))
        q = L.stateful(stream, processor, schema).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    got = {r.id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(data, kinds)
    fold = limits.cooldown(df, "key", "t", "id", 10) if batch == "cooldown" else limits.quota(df, "key", "t", "id", 2, 30)
    assert got == {r.id: r.accepted for r in fold.collect()}


def test_prompts_and_history(spark, tmp_path):
    kinds = "key bigint, t bigint, id bigint, kind string, text string"
    data = [(1, 0, 1, "prompt", ""), (1, 10, 2, "text", "answer"), (1, 11, 3, "text", "not asked"), (1, 20, 4, "prompt", ""), (1, 900, 5, "text", "too late")]
    for lo in (0, 1):
        spark.createDataFrame(data[lo * 1 : 1 if lo == 0 else None], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        for name, processor, schema in (("p", L.PromptProcessor(300), "key bigint, id bigint, text string"), ("h", L.HistoryProcessor(), "key bigint, id bigint, text string, prior string")):
            q = L.stateful(stream, processor, schema).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{name}")).option("path", str(tmp_path / f"o{name}")).trigger(availableNow=True).start()
            assert q.awaitTermination(180) and q.exception() is None
    assert {(r.id, r.text) for r in spark.read.parquet(str(tmp_path / "op")).collect()} == {(2, "answer")}
    assert {(r.id, r.prior) for r in spark.read.parquet(str(tmp_path / "oh")).collect()} == {(1, None), (2, ""), (3, "answer"), (4, "not asked"), (5, "")}


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    live = L.VersionedStore(spark, str(tmp_path / "store"))
    one = [(None, 1, i, None, 7, "S", i, f"first {i}") for i in range(3)]
    L.absorb(live, spark.createDataFrame(one, L.MESSAGE_SCHEMA), 0)
    before = live.manifest()

    def crash(self, manifest):
        raise RuntimeError("between the files and the manifest")

    monkeypatch.setattr(L.VersionedStore, "_publish", crash)
    with pytest.raises(RuntimeError):
        L.absorb(live, spark.createDataFrame([(None, 1, 1, None, 7, "S", 9, "edited")], L.MESSAGE_SCHEMA), 1)
    monkeypatch.undo()
    again = L.VersionedStore(spark, str(tmp_path / "store"))
    assert again.manifest() == before and again.last_batch() == 0
    assert {r.text for r in again.read("messages").collect()} == {f"first {i}" for i in range(3)}
    (tmp_path / "store" / "manifests" / "next-broken").write_text("{")
    L.absorb(again, spark.createDataFrame([(None, 1, 1, None, 7, "S", 9, "edited")], L.MESSAGE_SCHEMA), 1)
    assert {r.text for r in again.read("messages").collect()} == {"first 0", "edited", "first 2"} and again.last_batch() == 1
    assert {r.term for r in again.read("postings").collect()} == {"first", "0", "2", "edited"}
    number = again.manifest()["number"]
    assert number > before["number"]
    kept = again.cached("messages")
    assert again.cached("messages") is kept
    L.absorb(again, spark.createDataFrame([(None, 2, 1, None, 7, "S", 9, "other chat")], L.MESSAGE_SCHEMA), 2)
    assert again.cached("messages") is not kept and again.cached("messages").count() == 4
    again.forget()


def test_only_the_buckets_of_a_batch_are_written(spark, tmp_path):
    live = L.VersionedStore(spark, str(tmp_path / "store"))
    L.absorb(live, spark.createDataFrame([(None, c, 1, None, c, "S", 1, "x") for c in range(1, 40)], L.MESSAGE_SCHEMA))
    before = live.manifest()["tables"]["messages"]
    L.absorb(live, spark.createDataFrame([(None, 5, 2, None, 5, "S", 2, "y")], L.MESSAGE_SCHEMA))
    after = live.manifest()["tables"]["messages"]
    changed = {b for b in after if before.get(b) != after[b]}
    assert len(changed) <= 3 and len(before) > 10 and live.read("messages").count() == 40
    L.absorb(live, spark.createDataFrame([], L.MESSAGE_SCHEMA))
    assert live.read("messages").count() == 40


def test_adoption_takes_windows_marks_and_vectors_along(spark, tmp_path):
    live = L.VersionedStore(spark, str(tmp_path / "store"))
    L.absorb(live, spark.createDataFrame(rows(1, 31, 149, "old"), L.MESSAGE_SCHEMA))
    live.write({"prefs": spark.createDataFrame([(9, 149), (8, 3)], L.PREFS_SCHEMA)})
    L.flush(live)
    ids = {r.id for r in live.read("windows").collect()}
    L.absorb(live, spark.createDataFrame([(None, -100149, 30, None, 7, "Seven", 300, "live"), (None, -100149, 31, None, 7, "Seven", 310, "next")], L.MESSAGE_SCHEMA))
    for table in ("messages", "windows", "state", "vectors", "postings"):
        assert {r.chat_id for r in live.read(table).collect()} == {-100149}, table
    assert {(r.user_id, r.chat_id) for r in live.read("prefs").collect()} == {(9, -100149), (8, 3)}
    assert {r.id for r in live.read("windows").collect()} == ids == {r.window_id for r in live.read("vectors").collect()}
    assert {r.msg_id: r.text for r in live.read("messages").collect()}[30] == "live" and live.read("messages").count() == 31
    want = {(r.term, r.msg_id) for r in L.search.postings(live.read("messages")).collect()}
    assert {(r.term, r.msg_id) for r in live.read("postings").collect()} == want
    L.flush(live)
    assert live.read("state").first().last_indexed_msg_id == 31


def test_questions_are_flushed_read_searched_answered_and_logged(spark, tmp_path):
    from chatloom.streaming import engine

    live = L.VersionedStore(spark, str(tmp_path / "store"))
    talk = [(1, "the usual talk"), (2, "the wifi password is HappyMonday2024"), (3, "thanks"), (4, "lunch at noon?")]
    L.absorb(live, spark.createDataFrame([(None, 5, i, None, 7, "Nino", 1_700_000_000 + 9000 * i, t) for i, t in talk], L.MESSAGE_SCHEMA))
    q = spark.createDataFrame([(1, "wifi password", None), (2, "what did Nino say about lunch", None), (3, "and when was it", "lunch at noon"), (4, "password last year", None)], "qid bigint, question string, prior string")

    def model():
        return lambda system, prompt: "see [W1]"

    log = str(tmp_path / "log")
    got = {r.qid: r for r in engine.ask(live, q, model, "stub", now=1_800_000_000, log=log).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].answer == "see [W1]" and got[1].cited_ids == [got[1].window_ids[0]]
    assert got[3].question == "lunch at noon — follow-up: and when was it" and not got[4].window_ids  # last year is 2026
    texts = {r.id: r.text for r in live.read("windows").collect()}
    assert "HappyMonday2024" in texts[got[1].window_ids[0]] and len(texts) == 4
    assert spark.read.parquet(log).count() == 4
    asked = {r.qid: r.speaker for r in engine.read_questions(q, spark.createDataFrame([("Nino",), ("nina",)], "display_name string")).collect()}
    assert asked == {1: None, 2: "Nino", 3: None, 4: None}
    none = engine.ask(live, q, model, chats=[]).collect()
    assert all(not r.window_ids for r in none)
    cases = spark.createDataFrame([(1, "wifi password", ["HappyMonday2024"]), (2, "lunch", ["nowhere"])], "qid bigint, question string, needles array<string>")
    assert {r.qid: r.hit for r in engine.evaluate(live, cases).collect()} == {1: True, 2: False}


def test_a_new_job_of_a_key_cancels_the_old(spark):
    import threading
    import time

    flights, out = L.InFlight(spark), []

    def slow():
        return spark.range(0, 4, 1, 4).rdd.mapPartitions(lambda it: (time.sleep(30), iter(it))[1]).count()

    def first():
        try:
            flights.run("user", slow)
        except Exception as e:
            out.append(e)

    t = threading.Thread(target=first)
    t.start()
    time.sleep(4)
    assert flights.run("user", lambda: spark.range(3).count()) == 3
    t.join(20)
    assert out and not flights.cancel("user")


def test_an_unanswered_prompt_is_forgotten(spark, tmp_path):
    import time

    kinds = "key bigint, t bigint, id bigint, kind string, text string"
    put_events = lambda *rows: spark.createDataFrame(list(rows), kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put_events((1, 0, 1, "prompt", ""))
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    answers = L.stateful(stream, L.PromptProcessor(1, timers=True), "key bigint, id bigint, text string", "ProcessingTime")
    q = answers.writeStream.format("memory").queryName("prompts").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        def batches(n):  # until so many more are done
            last, until = (q.lastProgress or {"batchId": -1})["batchId"], time.time() + 60
            while (q.lastProgress or {"batchId": -1})["batchId"] < last + n and time.time() < until and q.exception() is None:
                time.sleep(0.2)
            assert q.exception() is None

        batches(1)
        time.sleep(1.5)
        batches(3)  # the timer fires in one of these
        put_events((1, 0, 2, "text", "in time by its own clock, but forgotten"), (2, 0, 3, "prompt", ""), (2, 1, 4, "text", "answer"))
        batches(4)
        assert [(r.id, r.text) for r in spark.table("prompts").collect()] == [(4, "answer")]
    finally:
        q.stop()
