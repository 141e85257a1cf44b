import random

import pytest

from chatloom.operators import limits


def events(spark, seed=0, n=300, keys=3):
    rng = random.Random(seed)
    rows = sorted((rng.randint(1, keys), rng.randint(0, 400), i) for i in range(n))
    return rows, spark.createDataFrame(rows, "k bigint, t bigint, id bigint")


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def test_cooldown_counts_what_passed(spark):
    rows, df = events(spark)
    want, last = {}, {}
    for k, t, i in rows:
        ok = k not in last or t - last[k] >= 10
        want[i] = (ok, 0.0 if ok else float(10 - (t - last[k])))
        if ok:
            last[k] = t
    assert by_id(limits.cooldown(df, "k", "t", "id", 10), "accepted", "wait") == want
    assert all(v == (True,) for v in by_id(limits.cooldown(df, "k", "t", "id", 0), "accepted").values())


def test_quota_slides(spark):
    rows, df = events(spark, 1)
    want, hits = {}, {}
    for k, t, i in rows:
        h = hits[k] = [x for x in hits.get(k, []) if x > t - 30]
        want[i] = (len(h) < 3,)
        if len(h) < 3:
            h.append(t)
    assert by_id(limits.quota(df, "k", "t", "id", 3, 30), "accepted") == want
    assert all(v == (True,) for v in by_id(limits.quota(df, "k", "t", "id", 0, 30), "accepted").values())


def test_an_event_exactly_a_window_old_is_free(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 30, 2), (1, 31, 3)], "k bigint, t bigint, id bigint")
    assert by_id(limits.quota(df, "k", "t", "id", 1, 30), "accepted", "wait") == {1: (True, 0.0), 2: (True, 0.0), 3: (False, 29.0)}


def test_both_levels_or_neither(spark):
    rows, df = events(spark, 2, keys=5)
    want, mine, all_ = {}, {}, []
    for t, i, k in sorted((t, i, k) for k, t, i in rows):
        all_ = [x for x in all_ if x > t - 30]
        h = mine[k] = [x for x in mine.get(k, []) if x > t - 30]
        blocked = "user" if len(h) >= 3 else "global" if len(all_) >= 7 else None
        if blocked is None:
            h.append(t)
            all_.append(t)
        want[i] = (blocked,)
    assert by_id(limits.two_level_quota(df, "k", "t", "id", 3, 7, 30), "blocked_by") == want


def test_bursts(spark):
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 5, 19, 20, 25, 60])], "k bigint, t bigint, id bigint")
    assert by_id(limits.coalesce_bursts(df, "k", "t", "id", 20), "sent", "suppressed") == {0: (True, 0), 1: (False, 0), 2: (False, 0), 3: (True, 2), 4: (False, 0), 5: (True, 1)}


def test_ttl(spark):
    facts = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k bigint, ts bigint, value string")
    asks = spark.createDataFrame([(1, t, t) for t in (9, 10, 19, 24, 25, 30)] + [(2, 15, 99)], "k bigint, ts bigint, id bigint")
    got = {r.id: r.value for r in limits.ttl_lookup(asks, facts, ["k"], 5).collect()}
    assert got == {9: None, 10: "a", 19: None, 24: "b", 25: None, 30: None, 99: None}


@pytest.mark.parametrize("fn", [lambda d: limits.cooldown(d, "k", "t", "id", 5), lambda d: limits.quota(d, "k", "t", "id", 2, 5), lambda d: limits.coalesce_bursts(d, "k", "t", "id", 5)])
def test_empty_and_null_keys(spark, fn):
    empty = spark.createDataFrame([], "k bigint, t bigint, id bigint")
    assert fn(empty).collect() == []
    assert fn(spark.createDataFrame([(None, 1, 1), (None, 2, 2)], "k bigint, t bigint, id bigint")).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_two_levels_are_cut_at_silences_only(spark, seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(600):
        t += rng.choice([0, 1, 1, 2, 3, 29, 30, 31, 200]) if seed else 1  # seed 0 is never quiet
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), t, i))
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint")
    want, mine, all_ = {}, {}, []
    for k, t, i in rows:
        all_ = [x for x in all_ if x > t - 30]
        h = mine[k] = [x for x in mine.get(k, []) if x > t - 30]
        blocked = "user" if len(h) >= 3 else "global" if len(all_) >= 7 else None
        if blocked is None:
            h.append(t)
            all_.append(t)
        want[i] = (blocked,)
    assert by_id(limits.two_level_quota(df, "k", "t", "id", 3, 7, 30), "blocked_by") == want
    assert limits.two_level_quota(df.where("false"), "k", "t", "id", 3, 7, 30).collect() == []


def test_keys_that_are_never_quiet_fill_partitions(spark, monkeypatch):
    from chatloom.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", 20)
    rows = sorted([(1, t, t) for t in range(0, 400)] + [(2, t, 1000 + t) for t in range(0, 300, 2)] + [(3, 5, 5000)])
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint")
    want, last, hits, kept = {}, {}, {}, {}
    for k, t, i in rows:
        want[i] = (k not in last or t - last[k] >= 7,)
        if want[i][0]:
            last[k] = t
        h = hits[k] = [x for x in hits.get(k, []) if x > t - 11]
        kept[i] = (len(h) < 2,)
        if len(h) < 2:
            h.append(t)
    assert by_id(limits.cooldown(df, "k", "t", "id", 7), "accepted") == want
    assert by_id(limits.quota(df, "k", "t", "id", 2, 11), "accepted") == kept


@pytest.mark.parametrize("chunk", [5, 1000])
def test_rows_are_carried_over_partitions(spark, monkeypatch, chunk):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from chatloom.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    rows = [(rng.choice([1, 1, 1, 1, None, 2, 3]), i, rng.random() < 0.1, f"v{i}" if rng.random() < 0.9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, f boolean, v string")
    order = Window.partitionBy("k").orderBy("i")
    want = {(r.i, r.a, r.b) for r in df.select("i", F.lag("v").over(order).alias("a"), F.lag("i").over(order).alias("b")).collect()}
    assert {(r.i, r.a, r.b) for r in ordered.carry_forward(df, ["k"], ["i"], {"v": "a", "i": "b"}).collect()} == want
    for inclusive in (False, True):
        frame = order.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        last = F.last(F.when(F.col("f"), F.struct("v", "i")), ignorenulls=True).over(frame)
        want = {(r.i, r.a, r.b) for r in df.withColumn("l", last).select("i", F.col("l.v").alias("a"), F.col("l.i").alias("b")).collect()}
        assert {(r.i, r.a, r.b) for r in ordered.carry_forward(df, ["k"], ["i"], {"v": "a", "i": "b"}, "f", inclusive).collect()} == want
    assert ordered.carry_forward(df.where("false"), ["k"], ["i"], {"v": "a"}).collect() == []
