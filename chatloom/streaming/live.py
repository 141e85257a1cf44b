"""Live messages: micro-batches that call the batch operators, and keyed state with timers.

A live store is a folder of tables. Each table is kept in buckets (of chats, or
of senders), a write makes new files for the buckets it changes only, and a
numbered manifest then says which files count. A manifest appears by one rename
and is never replaced, so a crash at any point leaves the one before it in
place, and the failed batch is repeated.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from chatloom.functions.parsing import export_chat_ids
from chatloom.operators import incremental, search, store
from chatloom.operators.windows import WindowRules, window_key
from chatloom.session import cut_lineage

MESSAGE_SCHEMA = "id bigint, chat_id bigint, msg_id bigint, reply_to bigint, sender_id bigint, sender string, ts bigint, text string"
WINDOW_SCHEMA = "id bigint, chat_id bigint, first_msg bigint, last_msg bigint, ts_start bigint, ts_end bigint, speakers string, text string"
STATE_SCHEMA = "chat_id bigint, last_indexed_msg_id bigint"
PEOPLE_SCHEMA = "sender_id bigint, display_name string, username string, source string, updated_at bigint"
ALIAS_SCHEMA = "sender_id bigint, ordinal bigint"
VECTOR_SCHEMA = "window_id bigint, chat_id bigint, vec array<float>"
POSTING_SCHEMA = "term string, chat_id bigint, msg_id bigint, tf bigint, positions array<int>, length int"
PREFS_SCHEMA = "user_id bigint, chat_id bigint"
SCHEMAS = {
    "messages": MESSAGE_SCHEMA, "windows": WINDOW_SCHEMA, "state": STATE_SCHEMA, "people": PEOPLE_SCHEMA, "aliases": ALIAS_SCHEMA,
    "vectors": VECTOR_SCHEMA, "postings": POSTING_SCHEMA, "prefs": PREFS_SCHEMA,
}
BY_SENDER = ("people", "aliases")
BUCKETS = 64
DIM = 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _key(table: str) -> str:
    return "sender_id" if table in BY_SENDER else "chat_id"


class VersionedStore:
    """Tables under one folder; ``manifests/N.json`` names the files of every bucket of every table as of write N."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.writing = threading.RLock()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._kept: dict[str, tuple[dict, DataFrame]] = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def manifest(self) -> dict:
        """The manifest with the highest number: {number, batch, tables: {table: {bucket: file}}}."""
        if not self._fs.exists(self._path("manifests")):
            return {"number": 0, "batch": -1, "tables": {}}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)
        if not number:
            return {"number": 0, "batch": -1, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{number:012d}.json", wholetext=True).first()[0])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        files = self.manifest()["tables"].get(table, {})
        chosen = [f"{self.folder}/{f}" for b, f in sorted(files.items()) if buckets is None or int(b) in buckets]
        if not chosen:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*chosen)

    def cached(self, table: str) -> DataFrame:
        """A table in memory, for as long as no write has changed it."""
        files = self.manifest()["tables"].get(table, {})
        known = self._kept.get(table)
        if known is None or known[0] != files:
            self.forget(table)
            self._kept[table] = (files, self.read(table).cache())
        return self._kept[table][1]

    def forget(self, table: str | None = None) -> None:
        """Drops what ``cached`` holds."""
        for name in [table] if table else list(self._kept):
            if name in self._kept:
                self._kept.pop(name)[1].unpersist()

    def write(self, tables: dict[str, DataFrame], batch: int | None = None, buckets: dict[str, list[int]] | None = None) -> None:
        """New files of the tables, then a new manifest.

        ``buckets``: for each table, the buckets its frame stands for; the others
        stay as they are. Without it the frame is the whole table. ``batch``: the
        micro-batch they hold. Files that no manifest of the last two names are removed.
        """
        with self.writing:
            now = self.manifest()
            number = now["number"] + 1
            then = {"number": number, "batch": now["batch"] if batch is None else batch, "tables": {t: dict(files) for t, files in now["tables"].items()}}
            for name, df in tables.items():
                path = f"{name}/v{number:012d}-{uuid.uuid4().hex[:8]}"
                rows = store.conform(df, self.spark.createDataFrame([], SCHEMAS[name]).schema).withColumn("__bucket", bucket_of(F.col(_key(name))))
                # by bucket and a part of its rows, so that a busy chat is written by several tasks
                rows.repartition("__bucket", F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("msg_id", "window_id", "id", "sender_id")] or ["chat_id"]), F.lit(8))).write.partitionBy("__bucket").parquet(f"{self.folder}/{path}")
                made = [f.getPath().getName() for f in self._fs.listStatus(self._path(path)) if f.isDirectory()]
                new = {n.split("=")[1]: f"{path}/{n}" for n in made if n.startswith("__bucket=")}
                renewed = None if buckets is None or name not in buckets else {str(b) for b in buckets[name]}
                kept = {} if renewed is None else {b: f for b, f in then["tables"].get(name, {}).items() if b not in renewed}
                then["tables"][name] = kept | new
            self._publish(then)
            self._clean(now, then)

    def _publish(self, manifest: dict) -> None:
        temporary = self._path(f"manifests/next-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"manifests/{manifest['number']:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise RuntimeError(f"write {manifest['number']} was made by another writer")

    def _clean(self, before: dict, after: dict) -> None:
        """Removes the versions that neither of the two manifests names; those of a failed write go as well."""
        named = {f.rsplit("/", 1)[0] for m in (before, after) for files in m["tables"].values() for f in files.values()}
        for table in after["tables"]:
            for f in self._fs.listStatus(self._path(table)):
                if f"{table}/{f.getPath().getName()}" not in named:
                    self._fs.delete(f.getPath(), True)

    def last_batch(self) -> int:
        return self.manifest()["batch"]


def _buckets(df: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(bucket_of(F.col(column)).alias("b")).distinct().collect())  # BUCKETS at most


def adopted(df: DataFrame, moves: DataFrame) -> DataFrame:
    """``df`` with the chats of ``moves`` (chat_id, live_id) under their live id; ``__moved`` marks the rows."""
    both = df.join(F.broadcast(moves), "chat_id", "left")
    return both.withColumn("__moved", F.col("live_id").isNotNull()).withColumn("chat_id", F.coalesce("live_id", "chat_id")).select(*df.columns, "__moved")


def remap_chats(messages: DataFrame, windows: DataFrame, state: DataFrame, prefs: DataFrame, moves: DataFrame) -> dict[str, DataFrame]:
    """The tables after chats have moved to other ids; ``moves``: (chat_id, live_id), a row per chat.

    Of a message that both chats have, that of the destination stays; windows of
    both are kept, as their vectors are; the larger high-water mark counts.
    """
    others = [c for c in windows.columns if c != "chat_id"]
    return {
        "messages": store.merge_mapped(adopted(messages, moves)).select(*messages.columns),
        "windows": adopted(windows, moves).select("chat_id", *others).select(*windows.columns),
        "state": adopted(state, moves).groupBy("chat_id").agg(F.max("last_indexed_msg_id").alias("last_indexed_msg_id")),
        "prefs": adopted(prefs, moves).select(*prefs.columns),
    }


def absorb(live: VersionedStore, batch: DataFrame, batch_id: int | None = None) -> None:
    """One micro-batch of deliveries into the message table and the term index.

    Messages stored under a chat's export id move to the live id on its first
    live message, with their windows, vectors, marks and preferences. Edits
    replace texts. Senders become people by trust. Only the buckets of the
    batch's chats and senders are read and written.
    """
    if batch_id is not None and batch_id <= live.last_batch():
        return  # it was written before the stream could note so
    batch = cut_lineage(store.conform(batch, live.spark.createDataFrame([], MESSAGE_SCHEMA).schema).dropna(subset=["chat_id", "msg_id"]))
    # as many rows as the micro-batch has chats
    moves = batch.select("chat_id").distinct().select(F.col("chat_id").alias("live_id"), F.explode(export_chat_ids(F.col("chat_id"))).alias("chat_id"))
    chats = sorted({*_buckets(batch, "chat_id"), *_buckets(moves, "chat_id")})
    stored = live.read("messages", chats)
    moved = cut_lineage(moves.join(stored.select("chat_id").distinct(), "chat_id", "left_semi"))
    moving = bool(moved.take(1))
    tables = {name: live.read(name, chats) for name in ("windows", "state", "prefs")}
    renewed = remap_chats(stored, tables["windows"], tables["state"], tables["prefs"], moved) if moving else {"messages": stored}
    old = renewed["messages"].withColumn("seq", F.lit(0).cast("bigint"))
    new = batch.withColumn("seq", F.coalesce("id", F.lit(0)) + 1)
    messages = cut_lineage(store.upsert_messages(old.unionByName(new), "seq").withColumn("id", F.lit(None).cast("bigint")))
    changed = messages.join(batch.select("chat_id", "msg_id").distinct(), ["chat_id", "msg_id"], "left_semi")
    index = live.read("postings", chats)
    if moving:  # all of an adopted chat anew
        ids = moved.select("chat_id").unionByName(moved.select(F.col("live_id").alias("chat_id")))
        index = index.join(F.broadcast(ids), "chat_id", "left_anti")
        changed = changed.unionByName(messages.join(F.broadcast(moved.select(F.col("live_id").alias("chat_id"))), "chat_id", "left_semi")).distinct()
    postings = search.refresh_postings(index, changed.select("chat_id", "msg_id", "text"))
    seen = batch.where("sender_id is not null").select(
        "sender_id", F.col("sender").alias("display_name"), F.lit(None).cast("string").alias("username"), F.lit("live").alias("source"), F.col("ts").alias("updated_at"), (F.col("ts") + 1).alias("seq")
    )
    senders = _buckets(seen, "sender_id")
    people = live.read("people", senders).withColumn("seq", F.lit(0).cast("bigint"))
    out = renewed | {"messages": messages, "postings": postings, "people": store.merge_people(people.unionByName(seen), "seq")}
    if moving:
        out["vectors"] = adopted(live.read("vectors", chats), moved).drop("__moved")
    live.write(out, batch_id, {name: senders if name in BY_SENDER else chats for name in out})


def flush(
    live: VersionedStore, lookback_days: int = 0, force: bool = False, chats: list[int] | None = None, rules: WindowRules = WindowRules(), mode: str = "name", every: int = 1, encoder: Callable | None = None,
) -> dict[str, int]:
    """Windows and embeds the messages that came since the last time, so that a search sees them: {chats, windows}.

    Only chats with at least ``every`` new messages are rebuilt, from their open
    tail; a lookback or ``force`` rebuilds all of ``chats``. Nothing is written
    if no chat is due, or the list of chats is empty.
    """
    with live.writing:
        messages, state = store.scoped(live.read("messages"), chats), live.read("state")
        plan = incremental.plan_update(messages, live.read("windows"), state, lookback_days, force)
        if every > 1 and not (lookback_days or force):
            plan = plan.join(incremental.due(messages, state, every).select("chat_id"), "chat_id", "left_semi")
        return _rebuild(live, cut_lineage(plan), rules, mode, encoder)


def reindex(live: VersionedStore, rules: WindowRules = WindowRules(), mode: str = "name", encoder: Callable | None = None) -> dict[str, int]:
    """All windows and vectors anew. The old version counts until the new one is whole."""
    with live.writing:
        return _rebuild(live, cut_lineage(incremental.plan_reindex(live.read("messages"))), rules, mode, encoder)


def _rebuild(live: VersionedStore, plan: DataFrame, rules: WindowRules, mode: str, encoder: Callable | None) -> dict[str, int]:
    buckets = _buckets(plan, "chat_id")
    if not buckets:
        return {"chats": 0, "windows": 0}
    messages = live.read("messages", buckets).join(plan.select("chat_id"), "chat_id", "left_semi")
    old = live.read("windows", buckets)
    aliases = store.assign_aliases(messages, live.read("aliases"))
    made = incremental.rebuild(messages, old, live.read("people"), aliases, plan, rules, mode)
    fresh = F.col("id").isNull()
    windows = cut_lineage(made.withColumn("__new", fresh).withColumn("id", F.coalesce("id", window_key("chat_id", "first_msg", "last_msg"))))
    # a window that was rebuilt lost its vector, and any that lacks one gets one: a crash before heals itself
    kept = store.without_orphans(live.read("vectors", buckets), windows.where("not __new"))
    pending = store.pending_vectors(windows.drop("__new"), kept)
    vectors = search.encode_texts(pending.select(F.col("id").alias("window_id"), "chat_id", "text"), DIM, encoder=encoder, prefix=search.PASSAGE).drop("text")
    state = incremental.watermarks(messages, plan, live.read("state", buckets))
    out = {"windows": windows.drop("__new"), "vectors": kept.select("window_id", "chat_id", "vec").unionByName(vectors.select("window_id", "chat_id", "vec")), "state": state, "aliases": aliases}
    live.write(out, buckets={"windows": buckets, "vectors": buckets, "state": buckets})
    return {"chats": plan.count(), "windows": windows.where("__new").count()}


def start_ingest(stream: DataFrame, live: VersionedStore, checkpoint: str, every: int = 20, available_now: bool = False, interval: str = "5 seconds") -> StreamingQuery:
    """A stream of deliveries into the store; chats with ``every`` new messages are windowed with their batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        absorb(live, batch, batch_id)
        flush(live, every=every)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def start_lookback(live: VersionedStore, lookback_days: int = 14, interval: str = "6 hours") -> StreamingQuery:
    """Rebuilds the windows of the last days again and again, for edits of messages that were windowed long ago."""
    ticks = live.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: flush(live, lookback_days)).trigger(processingTime=interval).start()


class InFlight:
    """Spark jobs by key: a new one of a key cancels the one that runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._tags = spark, threading.Lock(), {}

    def run(self, key: str, work: Callable[[], object]) -> object:
        context, tag = self.spark.sparkContext, f"{key}-{uuid.uuid4().hex[:8]}"
        with self._lock:
            self.cancel(key)
            self._tags[key] = tag
        context.addJobTag(tag)
        try:
            return work()
        finally:
            context.removeJobTag(tag)
            if self._tags.get(key) == tag:
                self._tags.pop(key)

    def cancel(self, key: str) -> bool:
        tag = self._tags.pop(key, None)
        if tag:
            self.spark.sparkContext.cancelJobsWithTag(tag)
        return tag is not None


# ---------------------------------------------------------------- keyed state


class CooldownProcessor(StatefulProcessor):
    """Events (key, t, id) as (key, id, accepted, wait); only what is accepted starts a new wait."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, i in zip(events["t"], events["id"]):
            wait = 0.0 if last is None or self.seconds <= 0 else max(0.0, self.seconds - (t - last))
            if not wait:
                last = float(t)
            out.append((key[0], i, not wait, float(wait)))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "id", "accepted", "wait"])

    def close(self) -> None:
        pass


class QuotaProcessor(StatefulProcessor):
    """At most ``limit`` accepted events in any ``window`` seconds."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        hits = [r[0] for r in self.hits.get()] if self.hits.exists() else []
        out = []
        for t, i in zip(events["t"], events["id"]):
            hits = [h for h in hits if h > t - self.window]
            free = self.limit <= 0 or len(hits) < self.limit
            out.append((key[0], i, free, 0.0 if free else float(hits[0] + self.window - t)))
            if free and self.limit > 0:
                hits.append(float(t))
        if hits:
            self.hits.put([(h,) for h in hits])
        elif self.hits.exists():
            self.hits.clear()
        yield pd.DataFrame(out, columns=["key", "id", "accepted", "wait"])

    def close(self) -> None:
        pass


class PromptProcessor(StatefulProcessor):
    """Events (key, t, id, kind, text): a ``prompt`` waits ``ttl`` seconds for the key's next ``text``, which then is its answer.

    ``timers``: a timer of the clock forgets a prompt that stays unanswered; the
    stream then needs ``time_mode="ProcessingTime"``.
    """

    def __init__(self, ttl: float, timers: bool = False):
        self.ttl, self.timers = ttl, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "t double")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        yield pd.DataFrame({"key": [], "id": [], "text": []}).astype({"key": "int64", "id": "int64", "text": "object"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        armed = self.armed.get()[0] if self.armed.exists() else None
        for t, i, kind, text in pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")[["t", "id", "kind", "text"]].itertuples(index=False):
            if kind == "prompt":
                armed = float(t)
            elif armed is not None:
                if t - armed <= self.ttl:
                    out.append((key[0], i, text))
                armed = None
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if armed is None:
            self.armed.clear()
        else:
            self.armed.update((armed,))
            if self.timers:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + int(self.ttl * 1000))
        yield pd.DataFrame(out, columns=["key", "id", "text"])

    def close(self) -> None:
        pass


class HistoryProcessor(StatefulProcessor):
    """Events (key, t, id, text) with the text before each, of the last ``keep`` that are remembered."""

    def __init__(self, keep: int = 4):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        out = []
        for _, i, text in pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")[["t", "id", "text"]].itertuples(index=False):
            out.append((key[0], i, text, past[-1] if past else None))
            past = [*past, text][-self.keep :]
        self.past.put([(p,) for p in past])
        yield pd.DataFrame(out, columns=["key", "id", "text", "prior"])

    def close(self) -> None:
        pass


ACCEPTED = "key bigint, id bigint, accepted boolean, wait double"


def stateful(events: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    """A keyed stream through a processor. The session needs the RocksDB state store provider."""
    return events.groupBy("key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)
