"""Overlapping conversation windows over messages, at any size of chat.

A window is closed before a message if the silence before it is too long and it
doesn't answer a message in the open window, or if the window has enough
messages or characters; unless it was a silence, the next window begins with
the last few messages of the closed one. The open window is always a run of the
latest messages, at most ``max_msgs`` of them, so the state of the fold is one
number: how many. A range partition can therefore be folded for every number it
might be entered with (the runs soon coincide), the partitions are linked by
those small tables, and a second pass writes the windows. No chat has to fit
into one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.parsing import alias_label, speaker_label, utc_minute
from chatloom.operators.ordered import chunk_of, ordered_chunks, runs


@dataclass(frozen=True)
class WindowRules:
    """gap seconds, messages, characters, and messages carried over. ``overlap`` 0 carries none."""

    gap: int = 1800
    max_msgs: int = 25
    max_chars: int = 1500
    overlap: int = 2

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.max_msgs:
            raise ValueError("overlap must be less than max_msgs")


_NONE = -(2**63)


class _Fold:
    """The fold over one run of messages, in lists."""

    def __init__(self, rules: WindowRules, ts: list, ids: list, refs: list, chars: list):
        self.rules, self.ts, self.ids, self.refs = rules, ts, ids, refs
        self.before = [0]
        for n in chars:
            self.before.append(self.before[-1] + n)

    def step(self, i: int, size: int) -> tuple[int, bool]:
        """Size of the window that holds message i, if ``size`` messages were open before it; and whether one was closed."""
        if not size:
            return 1, False
        r = self.rules
        first = i - size
        if self.ts[i] - self.ts[i - 1] > r.gap and (self.refs[i] == _NONE or self.refs[i] not in self.ids[first:i]):
            return 1, True
        if size >= r.max_msgs or self.before[i] - self.before[first] >= r.max_chars:
            return min(size, r.overlap) + 1, True
        return size + 1, False


def window_members(messages: DataFrame, rules: WindowRules = WindowRules()) -> DataFrame:
    """The windows as membership: one row per window and message.

    chat_id, window_end_ts, window_end_msg (the
    window's key: no two windows of a chat end at the same message), pos (from
    0), msg_id, ts.

    ``messages`` has a row per message: chat_id, msg_id, ts, reply_to, text.
    Rows with a null chat_id, msg_id or ts are left out; a null text has no
    characters. An empty table gives no row.
    """
    narrow = messages.dropna(subset=["chat_id", "msg_id", "ts"]).select(
        "chat_id", "ts", "msg_id", F.coalesce("reply_to", F.lit(_NONE)).alias("ref"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")
    )
    chunks = ordered_chunks(narrow, ["chat_id"], ["ts", "msg_id"])
    most = max(rules.max_msgs, rules.overlap + 1)
    columns = ("ts", "msg_id", "ref", "chars")

    def lists(table: pa.Table) -> list[list]:
        return [table.column(c).to_pylist() for c in columns]

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last messages of each partition's last run, and how the run lies in the partition."""
        out: list[tuple] = []
        for (chat,), table, first, last in runs(batches, ["chat_id"]):
            if first or last:
                out.append((chat, chunk_of(table), first, last, table.num_rows, *(v[-most:] for v in lists(table))))
        if out:
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["chat_id", "chunk", "first", "last", "n", *columns])

    schema = "chat_id bigint, chunk int, first boolean, last boolean, n bigint, " + ", ".join(f"{c} array<bigint>" for c in columns)
    # two runs per partition at most, of max_msgs short rows each
    edges = sorted(chunks.mapInArrow(tails, schema).collect(), key=lambda r: r["chunk"])
    halo: dict[tuple[int, int], list[list]] = {}
    open_tail: dict[int, list[list]] = {}
    for e in edges:
        if e["first"] and e["chat_id"] in open_tail:
            halo[e["chat_id"], e["chunk"]] = open_tail[e["chat_id"]]
        if e["last"]:
            past = open_tail.get(e["chat_id"], [[]] * 4) if e["first"] else [[]] * 4
            open_tail = {e["chat_id"]: [(p + list(e[c]))[-most:] for p, c in zip(past, columns)]}
        elif not e["first"]:
            open_tail = {}
    share_halo = chunks.sparkSession.sparkContext.broadcast(halo)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a run that goes on from the partition before: the open size it ends with, by the one it begins with."""
        out: list[tuple] = []
        for (chat,), table, first, _ in runs(batches, ["chat_id"]):
            past = share_halo.value.get((chat, chunk_of(table))) if first else None
            if past is None:
                break  # only the first run can be one
            h = len(past[0])
            fold = _Fold(rules, *(a + b for a, b in zip(past, lists(table))))
            state = {k: k for k in range(1, h + 1)}
            for i in range(h, h + table.num_rows):
                moved: dict[int, int] = {}
                for k in set(state.values()):
                    moved[k] = fold.step(i, k)[0]
                state = {k: moved[v] for k, v in state.items()}
            out += [(chat, chunk_of(table), k, v) for k, v in state.items()]
            break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["chat_id", "chunk", "k", "v"])

    def final_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a last run that begins in its partition: the open size it ends with."""
        out: list[tuple] = []
        for (chat,), table, first, last in runs(batches, ["chat_id"]):
            if last and not (first and (chat, chunk_of(table)) in share_halo.value):
                fold = _Fold(rules, *lists(table))
                size = 0
                for i in range(table.num_rows):
                    size, _ = fold.step(i, size)
                out.append((chat, chunk_of(table), 0, size))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["chat_id", "chunk", "k", "v"])

    entered: dict[tuple[int, int], int] = {}
    if halo:
        moves: dict[tuple[int, int], dict[int, int]] = {}
        table_schema = "chat_id bigint, chunk int, k int, v int"
        for r in chunks.mapInArrow(transfer, table_schema).unionByName(chunks.mapInArrow(final_size, table_schema)).collect():
            moves.setdefault((r["chat_id"], r["chunk"]), {})[r["k"]] = r["v"]
        size: dict[int, int] = {}
        for e in edges:
            key = (e["chat_id"], e["chunk"])
            if key in halo:
                entered[key] = size.get(e["chat_id"], 1)
            if e["last"]:
                size = {e["chat_id"]: moves[key][entered[key] if key in halo else 0]}
    share_size = chunks.sparkSession.sparkContext.broadcast(entered)
    goes_on = {(chat, chunk) for chat, chunk in halo}
    # the chunk before a halo chunk leaves its open window to the next
    leaves = set()
    last_chunk: dict[int, int] = {}
    for e in edges:
        key = (e["chat_id"], e["chunk"])
        if key in goes_on:
            leaves.add((e["chat_id"], last_chunk[e["chat_id"]]))
        if e["last"]:
            last_chunk = {e["chat_id"]: e["chunk"]}
    share_leaves = chunks.sparkSession.sparkContext.broadcast(leaves)
    names = ["chat_id", "window_end_ts", "window_end_msg", "pos", "msg_id", "ts"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chat,), table, first, last in runs(batches, ["chat_id"]):
            chunk = chunk_of(table)
            past = share_halo.value.get((chat, chunk)) if first else None
            now = lists(table)
            data = [a + b for a, b in zip(past, now)] if past else now
            fold = _Fold(rules, *data)
            h = len(past[0]) if past else 0
            size = share_size.value[chat, chunk] if past else 0
            spans: list[tuple[int, int]] = []
            for i in range(h, h + table.num_rows):
                moved, closed = fold.step(i, size)
                if closed:
                    spans.append((i - size, i))
                size = moved
            n = h + table.num_rows
            if not (last and (chat, chunk) in share_leaves.value):
                spans.append((n - size, n))
            if not spans:
                continue
            ts, ids = np.array(data[0], dtype=np.int64), np.array(data[1], dtype=np.int64)
            lengths = np.array([b - a for a, b in spans])
            ends = np.array([b - 1 for _, b in spans])
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            index = np.repeat(np.array([a for a, _ in spans]), lengths) + pos
            which = np.repeat(ends, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(index), chat, dtype=np.int64)), pa.array(ts[which]), pa.array(ids[which]), pa.array(pos.astype(np.int32)), pa.array(ids[index]), pa.array(ts[index])],
                names=names,
            )

    return chunks.mapInArrow(write, "chat_id bigint, window_end_ts bigint, window_end_msg bigint, pos int, msg_id bigint, ts bigint")


def window_spans(members: DataFrame) -> DataFrame:
    """chat_id, first_msg, last_msg, ts_start, ts_end, n_msgs of each window."""
    return (
        members.groupBy("chat_id", "window_end_ts", "window_end_msg")
        .agg(F.min_by("msg_id", "pos").alias("first_msg"), F.min_by("ts", "pos").alias("ts_start"), F.count("*").alias("n_msgs"))
        .select("chat_id", "first_msg", F.col("window_end_msg").alias("last_msg"), "ts_start", F.col("window_end_ts").alias("ts_end"), "n_msgs")
    )


def labelled(messages: DataFrame, people: DataFrame, aliases: DataFrame, mode: str = "name") -> DataFrame:
    """``messages`` with ``label``: how each sender is shown.

    People and aliases have a row per sender; whether they are broadcast is left
    to the planner, which knows their size.
    """
    known = people.select("sender_id", "display_name").join(aliases.select("sender_id", "ordinal"), "sender_id", "full")
    both = messages.join(known, "sender_id", "left")
    return both.withColumn("label", speaker_label(F.col("sender_id"), F.col("display_name"), F.col("sender"), F.col("ordinal"), mode)).drop("display_name", "ordinal")


def render_windows(members: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, first_msg, last_msg, ts_start, ts_end, speakers, text of each window.

    ``messages`` are labelled, a row per message. A window's rows are at most
    ``max_msgs``, so its transcript is put together in one place.
    """
    line = F.concat(F.lit("["), utc_minute(F.col("ts")), F.lit("] "), F.col("label"), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = members.join(messages.select("chat_id", "msg_id", "label", "text"), ["chat_id", "msg_id"])
    rows = lines.groupBy("chat_id", "window_end_ts", "window_end_msg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ts", "msg_id", line.alias("line"), "label"))).alias("rows")
    )
    return rows.select(
        "chat_id",
        F.col("rows")[0]["msg_id"].alias("first_msg"),
        F.col("window_end_msg").alias("last_msg"),
        F.col("rows")[0]["ts"].alias("ts_start"),
        F.col("window_end_ts").alias("ts_end"),
        F.array_join(F.array_sort(F.array_distinct(F.col("rows")["label"])), ", ").alias("speakers"),
        F.array_join(F.col("rows")["line"], "\n").alias("text"),
    )


def build_windows(messages: DataFrame, people: DataFrame, aliases: DataFrame, rules: WindowRules = WindowRules(), mode: str = "name") -> DataFrame:
    """The rendered windows of all chats; ``messages`` has a row per message."""
    return render_windows(window_members(messages, rules), labelled(messages, people, aliases, mode))


def window_key(chat_id, first_msg, last_msg):
    """A window's id where none is given: a hash of its place, the same in every run."""
    return F.xxhash64(chat_id, first_msg, last_msg)


__all__ = [
    "WindowRules", "alias_label", "build_windows", "labelled", "render_windows", "window_key", "window_members", "window_spans",
]
