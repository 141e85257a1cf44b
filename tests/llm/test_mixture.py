import pytest

from chatloom.llm.mixture import mix, mix_report, source_rates


@pytest.fixture
def tables(spark):
    sized = [("a", i, 10) for i in range(1000)] + [("b", i, 10) for i in range(100)] + [("c", 1, 5), ("unlisted", 1, 10**6), (None, 1, 7)]
    targets = [("a", 1.0, 1), ("b", 1.0, 3), ("c", 0.0, 5), ("none", 2.0, 9), ("a", 0.5, 1), (None, 9.0, 9), ("d", None, None), ("e", float("nan"), 2), ("f", -1.0, -1)]
    return spark.createDataFrame(sized, "source string, doc_id bigint, n_tokens bigint"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")


def test_rates(tables):
    r = {x.source: x for x in source_rates(*tables).collect()}
    assert set(r) == {"a", "b", "c", "none", "d", "e", "f"}
    total = 10_000 + 1_000 + 5
    assert r["a"].target_tokens == pytest.approx(total / 4) and r["a"].rate == pytest.approx(total / 4 / 10_000) and not r["a"].short
    assert r["b"].rate == pytest.approx(total / 4 / 1_000) and not r["b"].short
    assert r["none"].short and r["none"].docs == 0 and r["none"].rate == 0
    assert not r["c"].short and r["c"].rate == 0 and not r["d"].short


def test_an_exact_hit_is_not_short(spark):
    sized = spark.createDataFrame([("a", 1, 3), ("b", 2, 6)], "source string, doc_id bigint, n_tokens bigint")
    hit = spark.createDataFrame([("a", 2.0, 2), ("b", 1.0, 1)], "source string, weight double, max_repeats int")
    assert [x.source for x in source_rates(sized, hit).where("short").collect()] == []


def test_copies(tables):
    rows = mix(*tables).collect()
    b = [x for x in rows if x.source == "b"]
    per = {}
    for x in b:
        per[x.doc_id] = max(per.get(x.doc_id, 0), x.copy)
    assert set(per.values()) <= {2, 3} and len(per) == 100  # the rate is 2.75
    assert 250 <= len(b) <= 300
    a = [x for x in rows if x.source == "a"]
    assert {x.copy for x in a} == {1} and 200 <= len(a) <= 350
    assert {x.source for x in rows} == {"a", "b"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(*tables).collect()))


def test_report(tables):
    r = {x.source: x for x in mix_report(*tables).collect()}
    assert sum(x.actual_share for x in r.values()) == pytest.approx(1)
    assert r["none"].mixed_rows == 0
    empty = mix_report(tables[0].where("false"), tables[1]).collect()
    assert {x.mixed_tokens for x in empty} == {0} and {x.actual_share for x in empty} == {0.0} and len(empty) == len(r)
    assert mix(tables[0], tables[1].where("false")).collect() == []
