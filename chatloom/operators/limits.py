"""Rate limits and other folds over the events of a key, where what counts is only what was accepted.

A fold's state is bounded (a time, at most ``limit`` times, a count) and is as
good as new after a silence of a known length. So a key's events are spread over
range partitions like any order-dependent work: a partition with such a silence
tells the state it ends with whatever it was entered with, and only the times of
a key that fills partitions without one are followed from end to end, by one job.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.ordered import CHUNK, carry_forward, chunk_of, ordered_chunks, runs


class Fold:
    """``step(t)`` takes an event's time and gives its outputs; ``state`` is all that it remembers."""

    quiet: float  # after a silence this long the state is as good as new

    def __init__(self) -> None:
        self.state: list[float] = []

    def step(self, t: float) -> tuple:
        raise NotImplementedError


def _per_key(events: DataFrame, key: str, ts: str, tie: str, fold: Callable[[], Fold], names: list[str], kinds: list[str]) -> DataFrame:
    """``events`` with the fold's outputs, one fold per key over its events in order of (ts, tie).

    Events of a null key are one key. Events without a time are left out.
    """
    keyed = events.where(F.col(ts).isNotNull()).withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\x00")))
    chunks = ordered_chunks(keyed, ["__key"], [ts, tie])
    spark = events.sparkSession
    quiet = fold().quiet

    def times(table: pa.Table) -> list:
        return table.column(ts).to_pylist()

    def follow(begin: list[float] | None, values: list) -> list[float]:
        f = fold()
        f.state = list(begin or [])
        for t in values:
            f.step(t)
        return list(f.state)

    edge_schema = "k string, chunk int, first boolean, last boolean, known boolean, state array<double>"

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (k,), table, first, last in runs(batches, ["__key"]):
            if not (first or last):
                continue
            t = times(table)
            reset = next((i for i in range(len(t) - 1, 0, -1) if t[i] - t[i - 1] >= quiet), None if first else 0)
            out.append((k, chunk_of(table), first, last, reset is not None, [float(x) for x in follow(None, t[reset:])] if reset is not None else []))
        if out:
            types = [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["k", "chunk", "first", "last", "known", "state"])

    # two rows per partition at most
    rows = sorted(chunks.mapInArrow(edges, edge_schema).collect(), key=lambda r: (r["chunk"], not r["first"]))
    # partitions that a key fills without a silence: their ends follow from one another, key by key in one job
    unknown = {(r["k"], r["chunk"]) for r in rows if r["last"] and not r["known"]}
    begins: dict[tuple[str, int], list[float]] = {}
    before = None
    for r in rows:
        if (r["k"], r["chunk"]) in unknown and not (before and before["k"] == r["k"] and (before["k"], before["chunk"]) in unknown):
            begins[r["k"], r["chunk"]] = list(before["state"]) if r["first"] and before and before["last"] and before["k"] == r["k"] else []
        before = r
    ends: dict[tuple[str, int], list[float]] = {}
    if unknown:
        asked = spark.sparkContext.broadcast((frozenset(unknown), begins))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield batch.filter(pa.array([p in asked.value[0] for p in pairs], pa.bool_()))

        def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, f, at = [], fold(), None
            for batch in batches:
                for k, chunk, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if (k, chunk) != at:
                        if at is not None:
                            out.append((*at, list(f.state)))
                        if (k, chunk) in asked.value[1]:
                            f = fold()
                            f.state = list(asked.value[1][k, chunk])
                        at = (k, chunk)
                    f.step(t)
            if at is not None:
                out.append((*at, list(f.state)))
                types = [pa.string(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([[float(x) for x in v] if i == 2 else v for v in c], t) for i, (c, t) in enumerate(zip(zip(*out), types))], names=["k", "chunk", "state"])

        times_of = dict(chunks.dtypes)
        narrow = chunks.select("__key", CHUNK, ts, tie).mapInArrow(chosen, f"__key string, `{CHUNK}` int, `{ts}` {times_of[ts]}, `{tie}` {times_of[tie]}")
        ordered = narrow.repartition("__key").sortWithinPartitions("__key", CHUNK, ts, tie)
        ends = {(r["k"], r["chunk"]): list(r["state"]) for r in ordered.mapInArrow(chain, "k string, chunk int, state array<double>").collect()}
    entered: dict[tuple[str, int], list[float]] = {}
    left: tuple[str, list[float]] | None = None
    for r in rows:
        k, chunk = r["k"], r["chunk"]
        if r["first"] and left is not None and left[0] == k:
            entered[k, chunk] = left[1]
        if r["last"]:
            left = (k, ends[k, chunk] if (k, chunk) in ends else list(r["state"]))
    share = spark.sparkContext.broadcast(entered)
    columns = events.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    types = [pa.bool_() if k == "boolean" else pa.float64() if k == "double" else pa.int64() for k in kinds]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k,), table, first, _ in runs(batches, ["__key"]):
            f = fold()
            f.state = list(share.value.get((k, chunk_of(table)), [])) if first else []
            out = list(zip(*(f.step(t) for t in times(table))))
            whole = pa.table([*(table.column(c) for c in columns), *(pa.array(c, t) for c, t in zip(out, types))], names=[*columns, *names])
            yield from whole.combine_chunks().to_batches()

    return chunks.mapInArrow(fn, fields + "".join(f", `{n}` {k}" for n, k in zip(names, kinds)))


class _Cooldown(Fold):
    def __init__(self, seconds: float):
        super().__init__()
        self.quiet = self.seconds = seconds

    def step(self, t: float) -> tuple:
        wait = self.seconds - (t - self.state[0]) if self.state and self.seconds > 0 else 0.0
        if wait > 0:
            return False, float(wait)
        self.state = [t]
        return True, 0.0


def cooldown(events: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """accepted, wait: an event passes unless the last one that passed is less than ``seconds`` ago."""
    return _per_key(events, key, ts, tie, lambda: _Cooldown(seconds), ["accepted", "wait"], ["boolean", "double"])


class _Quota(Fold):
    def __init__(self, limit: int, window: float):
        super().__init__()
        self.limit, self.window = limit, window
        self.quiet = window if limit > 0 else 0.0

    def step(self, t: float) -> tuple:
        if self.limit <= 0:
            return True, 0.0
        self.state = [h for h in self.state if h > t - self.window]
        if len(self.state) < self.limit:
            self.state.append(t)
            return True, 0.0
        return False, float(self.state[0] + self.window - t)


def quota(events: DataFrame, key: str, ts: str, tie: str, limit: int, window: float = 3600.0) -> DataFrame:
    """accepted, wait: at most ``limit`` events pass in any ``window``; one exactly that long ago no longer counts. 0: no limit."""
    return _per_key(events, key, ts, tie, lambda: _Quota(limit, window), ["accepted", "wait"], ["boolean", "double"])


def two_level_quota(events: DataFrame, user: str, ts: str, tie: str, user_limit: int, global_limit: int, window: float = 3600.0) -> DataFrame:
    """blocked_by: null, ``user`` or ``global``. A request that either level refuses uses up neither.

    After a silence of ``window`` both levels are empty, so the events are cut
    there and the parts fold on their own; a part is one key by its nature and
    streams through one task, with the accepted events of one window as its state.
    """
    chunks = ordered_chunks(events.where(F.col(ts).isNotNull()), [], [ts, tie])

    def silences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = chunk = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy(zero_copy_only=False)
                n += int((np.diff(t if last is None else np.concatenate([[last], t])) >= window).sum())
                first, last, chunk = t[0] if first is None else first, t[-1], batch.column(1)[0].as_py()
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([float(first)]), pa.array([float(last)]), pa.array([n], pa.int64())], names=["c", "a", "b", "n"])

    starts: dict[int, tuple[int, float | None]] = {}
    part, past = 0, None
    for r in sorted(chunks.select(ts, CHUNK).mapInArrow(silences, "c int, a double, b double, n bigint").collect(), key=lambda r: r["c"]):  # a row for each partition
        starts[r["c"]] = (part, past)
        part += r["n"] + (past is not None and r["a"] - past >= window)
        past = r["b"]
    share = events.sparkSession.sparkContext.broadcast(starts)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    ts_at, chunk_at = chunks.columns.index(ts), chunks.columns.index(CHUNK)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                t = batch.column(ts_at).to_numpy(zero_copy_only=False)
                number, last = share.value[batch.column(chunk_at)[0].as_py()] if state is None else state
                quiet = np.diff(np.concatenate([[t[0] if last is None else last], t])) >= window
                numbers = number + np.cumsum(quiet)
                state = (int(numbers[-1]), t[-1])
                kept = [(c, v) for i, (c, v) in enumerate(zip(batch.schema.names, batch.columns)) if i != chunk_at]
                yield pa.RecordBatch.from_arrays([*(v for _, v in kept), pa.array(numbers.astype(np.int64))], names=[*(c for c, _ in kept), "__part"])

    cut = chunks.mapInArrow(parts, fields + ", __part bigint").repartition("__part").sortWithinPartitions("__part", ts, tie)

    at_columns = (events.columns.index(user), events.columns.index(ts))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[object, deque] = {}
        everyone: deque = deque()
        at = None
        for batch in batches:
            out = []
            for p, u, t in zip(*(batch.column(i).to_pylist() for i in (batch.num_columns - 1, *at_columns))):
                if p != at:
                    mine, everyone, at = {}, deque(), p
                while everyone and everyone[0][0] <= t - window:
                    old = everyone.popleft()[1]
                    mine[old].popleft()
                    if not mine[old]:
                        del mine[old]
                if user_limit > 0 and len(mine.get(u, ())) >= user_limit:
                    out.append("user")
                elif global_limit > 0 and len(everyone) >= global_limit:
                    out.append("global")
                else:
                    mine.setdefault(u, deque()).append(t)
                    everyone.append((t, u))
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "blocked_by"])

    return cut.mapInArrow(fn, fields + ", blocked_by string")


class _Burst(Fold):
    def __init__(self, interval: float):
        super().__init__()
        self.quiet = self.interval = interval

    def step(self, t: float) -> tuple:
        if self.state and t - self.state[0] < self.interval:
            self.state[1] += 1
            return False, 0
        held = int(self.state[1]) if self.state else 0
        self.state = [t, 0]
        return True, held


def coalesce_bursts(events: DataFrame, key: str, ts: str, tie: str, interval: float) -> DataFrame:
    """sent, suppressed: the first of a burst passes; the next one that passes tells how many were held back before it."""
    return _per_key(events, key, ts, tie, lambda: _Burst(interval), ["sent", "suppressed"], ["boolean", "bigint"])


def ttl_lookup(asks: DataFrame, facts: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """``asks`` (keys, ts, id) with ``value``: the latest fact of the keys at or before ts, unless ``ttl`` seconds old by then.

    An as-of join without a join: both are laid in one order per key and the last
    fact is carried forward. A fact at the same second as the question counts.
    """
    both = facts.select(*keys, "ts", F.lit(0).alias("__kind"), F.lit(None).cast("bigint").alias("id"), "value").unionByName(
        asks.select(*keys, "ts", F.lit(1).alias("__kind"), F.col("id"), F.lit(None).cast(dict(facts.dtypes)["value"]).alias("value"))
    )
    asked = both.withColumns({"__fact": F.col("__kind") == 0, "__id": F.coalesce("id", F.lit(-(2**63)))})
    held = carry_forward(asked, keys, ["ts", "__kind", "__id"], {"ts": "__ts", "value": "__value"}, "__fact", inclusive=True).where("__kind = 1")
    return held.select(*keys, "ts", "id", F.when(F.col("ts") - F.col("__ts") < ttl, F.col("__value")).alias("value"))
