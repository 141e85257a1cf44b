import json

import pytest
from pyspark.sql import functions as F

from chatloom.operators import store
from chatloom.sources import export


def test_upsert_keeps_the_first_and_takes_the_last_text(messages_of):
    rows = [(2, 1, 1, 5, 7, "b", 10, "edited"), (1, 1, 1, None, None, "a", 9, "first"), (3, 1, 2, None, None, None, 1, None), (None, 1, 2, 4, 4, "z", 2, "older"), (4, None, 1, None, None, None, 1, "x")]
    got = {(r.chat_id, r.msg_id, r.reply_to, r.sender, r.ts, r.text) for r in store.upsert_messages(messages_of(rows)).collect()}
    assert got == {(1, 1, None, "a", 9, "edited"), (1, 2, 4, "z", 2, None)}


def test_people_by_trust(spark):
    rows = [(1, "Live", None, "live", 1, 1), (1, "Manual ", "m", "manual", 2, 2), (1, "Api", None, "api", 3, 3), (2, "A", None, "live", 1, 1), (2, "B", None, "odd", 2, 2), (3, "", None, "manual", 1, 1), (None, "X", None, "api", 1, 1)]
    df = spark.createDataFrame(rows, "sender_id bigint, display_name string, username string, source string, updated_at bigint, seq bigint")
    assert {(r.sender_id, r.display_name) for r in store.merge_people(df, "seq").collect()} == {(1, "Manual"), (2, "B")}


def test_merge_chats(messages_of, spark):
    m = messages_of([(1, 149, 1, None, None, "a", 1, "old"), (2, -100149, 1, None, None, "a", 1, "live"), (3, 149, 2, None, None, "a", 2, "only old")]).drop("id")
    assert {(r.chat_id, r.msg_id, r.text) for r in store.merge_chats(m, 149, -100149).collect()} == {(-100149, 1, "live"), (-100149, 2, "only old")}
    s = spark.createDataFrame([(149, 9), (-100149, 3), (5, 1)], "chat_id bigint, last_indexed_msg_id bigint")
    assert {tuple(r) for r in store.merge_state(s, 149, -100149).collect()} == {(-100149, 9), (5, 1)}


def test_aliases_go_on(spark):
    have = spark.createDataFrame([(100, 1), (300, 2), (500, 3)], "sender_id bigint, ordinal bigint")
    new = spark.createDataFrame([(999,), (100,), (50,), (None,), (999,)], "sender_id bigint")
    assert {tuple(r) for r in store.assign_aliases(new, have).collect()} == {(100, 1), (300, 2), (500, 3), (50, 4), (999, 5)}
    assert {tuple(r) for r in store.assign_aliases(new, have.where("false")).collect()} == {(50, 1), (100, 2), (999, 3)}


def test_key_values_and_scope(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, None, 2)], "k bigint, v string, s bigint")
    assert {tuple(r) for r in store.key_values(df, "k", "v", "s").collect()} == {(1, "b")}
    c = spark.createDataFrame([(1,), (2,)], "chat_id bigint")
    assert (store.scoped(c, None).count(), store.scoped(c, 1).count(), store.scoped(c, []).count(), store.scoped(c, [1, 2, 3]).count()) == (2, 1, 0, 2)
    with pytest.raises(TypeError):
        store.scoped(c, "1")


def test_columns_are_added_once(spark):
    df = spark.range(1)
    assert store.ensure_column(store.ensure_column(df, "n", "bigint"), "n", "bigint").columns == ["id", "n"]
    for bad in ("a b", "a;--", "", "1a"):
        with pytest.raises(ValueError):
            store.ensure_column(df, bad, "string")


def entry(i, text, **more):
    return {"id": i, "type": "message", "date_unixtime": "100", "from": "A", "from_id": "user7", "text": text} | more


def test_an_export_is_loaded_and_loaded_again(spark, tmp_path):
    doc = {"name": "Team", "type": "private_supergroup", "id": 77, "messages": [
        {"id": 1, "type": "service", "date_unixtime": "1", "text": "joined"}, entry(2, "plain"), entry(3, ["a ", {"type": "bold", "text": "b"}, {"type": "x"}, 5]), entry(4, '["looks like a list"]'),
        entry(5, "  "), entry(6, []), entry(7, "no time", date_unixtime=None), entry(8, "iso", date_unixtime="soon", date="2024-01-01T00:00:00"), {"type": "message", "date_unixtime": "5", "text": "no id"},
        entry(9, "x", **{"from": None, "actor": "Actor", "reply_to_message_id": 2}), entry(10, "y", **{"from": "", "from_id": None}), entry(2, "plain, again"),
    ]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = {r.msg_id: r for r in export.load_exports(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in rows.items()} == {2: "plain, again", 3: "a b", 4: '["looks like a list"]', 8: "iso", 9: "x", 10: "y"}
    assert all(r.chat_id == -10077 for r in rows.values()) and rows[9].sender == "Actor" and rows[9].reply_to == 2 and rows[10].sender == "Unknown" and rows[10].sender_id is None
    stored = spark.createDataFrame([(77, 2, None, 1, "Old", 5, "stored"), (77, 50, None, 1, "Old", 5, "kept")], "chat_id bigint, msg_id bigint, reply_to bigint, sender_id bigint, sender string, ts bigint, text string")
    again = {r.msg_id: r for r in export.load_exports(spark, str(tmp_path), stored).collect()}
    assert again[2].text == "plain, again" and again[2].ts == 5 and again[50].chat_id == -10077 and len(again) == 7
    [c] = export.load_counts(export.read_exports(spark, str(tmp_path))).collect()
    assert (c.chat_name, c.in_file, c.usable) == ("Team", 12, 6)


def test_an_export_without_an_id_fails(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"messages": [entry(1, "x")]}))
    with pytest.raises(Exception, match="no chat id"):
        export.load_exports(spark, str(tmp_path)).collect()


def test_variant_texts(spark):
    df = spark.createDataFrame([('"a"',), ('[{"type":"text","text":"x"},{"type":"image","text":"no"}," y "]',), ("5",), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in df.select(export.content_text(F.col("v"))).collect()][:3] == ["a", "x y", ""]
    df = spark.createDataFrame([('{"error":{"message":"busy"}}',), ('{"error":"down"}',), ("not json",), ("[]",)], "j string")
    assert [r[0] for r in df.select(export.error_text(F.col("j"), F.lit("?"))).collect()] == ["busy", "down", "?", "?"]


def test_log_and_template(spark, tmp_path, messages_of):
    log = spark.createDataFrame([(1, "q", None, [1], [], 5, "m")], "ts bigint, question string, chat_ids array<bigint>, window_ids array<bigint>, cited_ids array<bigint>, latency_ms bigint, model string")
    export.append_query_log(log, str(tmp_path / "log"))
    export.append_query_log(log, str(tmp_path / "log"))
    export.append_query_log(log, str(tmp_path / "off"), enabled=False)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and not (tmp_path / "off").exists()
    m = messages_of([(1, 1, 1, None, 7, "label", 1, "x"), (2, 1, 2, None, 7, "label", 1, "x"), (3, 1, 3, None, 8, None, 1, "x")])
    people = spark.createDataFrame([(8, "Eight", "api")], "sender_id bigint, display_name string, source string")
    export.write_template(store.sender_template(m, people), str(tmp_path / "t"))
    assert {(r.sender_id, r.messages, r.name, r.source) for r in spark.read.json(str(tmp_path / "t")).collect()} == {(7, 2, "label", "export-label"), (8, 1, "Eight", "api")}
    (tmp_path / "map.json").write_text(json.dumps([{"sender_id": 1, "name": "N", "username": "u"}, {"sender_id": 2, "name": ""}]))
    assert store.merge_people(export.read_mapping(spark, str(tmp_path / "map.json")).withColumn("seq", F.lit(1)), "seq").count() == 1
