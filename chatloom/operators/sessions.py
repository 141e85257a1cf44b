"""Sessions of activity, cut from a Cartesian tree over the gaps between events.

For each entity (a chat, a user, a device) the gaps between consecutive events
form a Cartesian tree: the largest gap is the root and splits the events into a
left and a right part, and so on down to the single events. Each node knows the
run of events below it and the gap of its parent, hence

    the sessions at threshold T are the nodes with gap <= T < parent_gap,

for any T, by one filter. A tree is built in chunks (range partitions of entity
and time). A chunk finishes every node whose run ends inside it; what is left
are the nodes on the chunk's two spines, in number the running maxima of the
gaps, and these are merged per entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.ordered import chunk_of, ordered_chunks, partition_id, runs
from chatloom.session import cut_lineage

LEAF = -1  # the "gap" of a single event
TOP = 2**62  # the parent gap of an entity's root
_NONE = -(2**63)  # a missing reply in the arrays
CHUNK_ROWS = 250_000  # events of a chunk; the nodes of one take some 100 MB

_NODE = [
    "gap", "parent_gap", "first_ts", "first_id", "first_ref", "last_ts", "last_id", "n",
]

def _boundaries(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For gaps[i], the nearest index to the left with gap >= it, to the right with gap > it.

    Gap i lies before event i; index 0 and len(gaps) are the borders of the run.
    """
    n = len(gaps)
    left = np.zeros(n, dtype=np.int64)
    right = np.full(n, n, dtype=np.int64)
    stack: list[int] = []
    values = gaps.tolist()
    for i in range(1, n):
        value = values[i]
        while stack and values[stack[-1]] < value:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else 0
        stack.append(i)
    return left, right


def _grow(ts: np.ndarray, ids: np.ndarray, refs: np.ndarray) -> pd.DataFrame:
    """The nodes of one run of events: 2n - 1 rows, borders unknown marked."""
    n = len(ts)
    gaps = np.empty(n + 1, dtype=np.int64)
    gaps[0] = gaps[n] = TOP
    gaps[1:n] = ts[1:] - ts[:-1]
    left, right = _boundaries(gaps[:n])
    inner = np.arange(1, n)
    low = np.concatenate([left[1:n], np.arange(n)])
    high = np.concatenate([right[1:n], np.arange(1, n + 1)])
    return pd.DataFrame(
        {
            "gap": np.concatenate([gaps[inner], np.full(n, LEAF)]),
            "parent_gap": np.minimum(gaps[low], gaps[high]),
            "first_ts": ts[low], "first_id": ids[low], "first_ref": refs[low],
            "last_ts": ts[high - 1], "last_id": ids[high - 1],
            "n": high - low,
            "pos": np.concatenate([inner, np.arange(n)]),
            "left_known": (low > 0).astype(np.int32),
            "right_known": (high < n).astype(np.int32),
        }
    )


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Finishes the open nodes of one entity over all its chunks."""
    pdf = pdf.sort_values(["chunk", "pos", "gap"], kind="stable")
    edges = pdf[pdf["open"] == 2]
    nodes = pdf[pdf["open"] == 1]
    # the gap nodes of the merged sequence: links between chunks, and the chunks' spines
    order: list[tuple] = []  # (chunk, pos, gap, events before the gap in its chunk, key of the event after, event before)
    starts: dict[int, int] = {}
    total = 0
    previous = None
    for e in edges.itertuples():
        starts[e.chunk] = total
        if previous is not None:
            order.append((total, e.first_ts - previous.last_ts, (e.first_ts, e.first_id, e.first_ref), (previous.last_ts, previous.last_id)))
        total += e.n
        previous = e
    first, last = edges.iloc[0], edges.iloc[-1]
    spine = nodes[nodes["gap"] >= 0]
    for g in spine.itertuples():
        # the event after the gap, and the one before it, travel with each open gap node
        order.append((starts[g.chunk] + g.pos, g.gap, (g.at_ts, g.at_id, g.at_ref), (g.before_ts, g.before_id)))
    order.sort(key=lambda x: x[0])
    positions = np.array([-1, *[x[0] for x in order]], dtype=np.int64)
    gaps = np.array([TOP, *[x[1] for x in order]], dtype=np.int64)
    left, right = _boundaries(gaps)
    at = {x[0]: i + 1 for i, x in enumerate(order)}
    out = []

    def row(gap: int, low: int, high: int) -> tuple:
        begin = order[low - 1][2] if low else (first.first_ts, first.first_id, first.first_ref)
        end = order[high - 1][3] if high < len(gaps) else (last.last_ts, last.last_id)
        begin_pos = positions[low] if low else 0
        end_pos = positions[high] if high < len(gaps) else total
        parent = min(gaps[low] if low else TOP, gaps[high] if high < len(gaps) else TOP)
        return (gap, parent, *begin, *end, end_pos - begin_pos)

    for i in range(1, len(gaps)):
        out.append(row(gaps[i], left[i], right[i]))
    leaves = nodes[nodes["gap"] == LEAF]
    sequence = positions[1:]
    for leaf in leaves.itertuples():
        p = starts[leaf.chunk] + leaf.pos
        low = int(np.searchsorted(sequence, p, side="right"))  # the last gap at or before the event
        known_low, known_high = leaf.left_known, leaf.right_known
        left_gap = leaf.left_gap if known_low else (gaps[low] if low else TOP)
        right_gap = leaf.right_gap if known_high else (gaps[low + 1] if low + 1 < len(gaps) else TOP)
        out.append((LEAF, min(left_gap, right_gap), leaf.first_ts, leaf.first_id, leaf.first_ref, leaf.last_ts, leaf.last_id, 1))
    done = pd.DataFrame(out, columns=_NODE)
    done.insert(0, "entity", pdf["entity"].iloc[0])
    return done


def _can_matter(nodes: pd.DataFrame, at: int) -> np.ndarray:
    """The nodes of a run that a cut at one threshold needs, whatever lies before and after it.

    Sessions are nodes up to the threshold without a known border up to it. Of the
    gaps above the threshold the first and the last of the run set it off from
    its neighbours. So a run leaves a handful of open nodes, be its gaps all equal.
    """
    low = nodes["gap"].to_numpy() <= at
    top = low & (nodes["parent_gap"].to_numpy() > at)  # the parent's gap is the smaller of the borders, unknown ones being high
    above = nodes["pos"].where(~low)
    return top | (~low & ((above == above.min()) | (above == above.max())).to_numpy())


_OPEN_SCHEMA = (
    "entity bigint, gap bigint, parent_gap bigint, first_ts bigint, first_id bigint, first_ref bigint, last_ts bigint, "
    "last_id bigint, n bigint, open int, chunk int, pos bigint, left_known int, right_known int, left_gap bigint, "
    "right_gap bigint, at_ts bigint, at_id bigint, at_ref bigint, before_ts bigint, before_id bigint"
)
_OPEN_COLUMNS = [c.split()[0] for c in _OPEN_SCHEMA.split(", ")]
_ARROW = pa.schema([(c, pa.int32() if c in ("open", "chunk", "left_known", "right_known") else pa.int64()) for c in _OPEN_COLUMNS])


def gap_tree(events: DataFrame, at: int | None = None) -> DataFrame:
    """The Cartesian tree over the gaps of each entity's events.

    ``events`` has (entity, ts, id, ref), all long, one row per event, ref
    nullable; order is (ts, id). Rows with a null entity, ts or id have no place
    in an order and are left out. The result has a row per node: ``entity, gap,
    parent_gap, first_ts, first_id, first_ref, last_ts, last_id, n``; leaves
    have gap -1, roots parent_gap 2**62. With ``at`` only the nodes that are a
    session at that threshold are kept, which is all a single cut needs.
    Repeated (entity, ts, id) rows count each; an empty table gives no node.
    """
    events = events.select("entity", "ts", "id", F.coalesce("ref", F.lit(_NONE)).alias("ref")).dropna(subset=["entity", "ts", "id"])
    n = max(2, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // CHUNK_ROWS))
    chunks = events.repartitionByRange(n, "entity", "ts", "id").sortWithinPartitions("entity", "ts", "id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = partition_id()
        buffer: list[pd.DataFrame] = []
        held = 0
        for (entity,), table, first, last in runs(batches, ["entity"]):
            ts, ids, refs = (table.column(c).to_numpy() for c in ("ts", "id", "ref"))
            nodes = _grow(ts, ids, refs)
            nodes["entity"] = entity
            nodes["chunk"] = np.int32(chunk)
            nodes["open"] = np.int32(0)
            for c in ("left_gap", "right_gap", "at_ts", "at_id", "at_ref", "before_ts", "before_id"):
                nodes[c] = np.int64(0)
            if first or last:  # the entity may go on in the chunk before or after
                if at is not None:
                    nodes = nodes[_can_matter(nodes, at)]
                waits = ((nodes["left_known"] == 0) & first) | ((nodes["right_known"] == 0) & last)
                part = nodes[waits].copy()
                part["open"] = np.int32(1)
                if not first:
                    part["left_known"] = np.int32(1)
                if not last:
                    part["right_known"] = np.int32(1)
                p = part["pos"].to_numpy()
                leaf = part["gap"].to_numpy() == LEAF
                gaps = np.concatenate([[TOP], ts[1:] - ts[:-1], [TOP]]).astype(np.int64)
                part["left_gap"] = gaps[p]
                part["right_gap"] = np.where(leaf, gaps[np.minimum(p + 1, len(ts))], 0)
                part["at_ts"], part["at_id"], part["at_ref"] = ts[p], ids[p], refs[p]
                part["before_ts"], part["before_id"] = ts[np.maximum(p - 1, 0)], ids[np.maximum(p - 1, 0)]
                edge = dict.fromkeys(_OPEN_COLUMNS, 0) | {
                    "entity": entity, "chunk": chunk, "open": 2, "n": len(ts), "first_ts": ts[0], "first_id": ids[0],
                    "first_ref": refs[0], "last_ts": ts[-1], "last_id": ids[-1],
                }
                nodes = pd.concat([nodes[~waits], part, pd.DataFrame([edge])])
            if at is not None:
                nodes = nodes[(nodes["open"] > 0) | ((nodes["gap"] <= at) & (nodes["parent_gap"] > at))]
            buffer.append(nodes[_OPEN_COLUMNS])
            held += len(nodes)
            if held > 50_000:
                yield pa.RecordBatch.from_pandas(pd.concat(buffer), schema=_ARROW, preserve_index=False)
                buffer, held = [], 0
        if buffer:
            yield pa.RecordBatch.from_pandas(pd.concat(buffer), schema=_ARROW, preserve_index=False)

    built = cut_lineage(chunks.mapInArrow(build, _OPEN_SCHEMA))
    closed = built.where("open = 0").select("entity", *_NODE)
    merged = built.where("open > 0").groupBy("entity").applyInPandas(_merge, ", ".join(f"{c} bigint" for c in ["entity", *_NODE]))
    return closed.unionByName(merged).withColumn("first_ref", F.when(F.col("first_ref") != _NONE, F.col("first_ref")))


def cut_tree(tree: DataFrame, threshold: int) -> DataFrame:
    """The sessions of a gap tree: no two neighbours in a session are more than ``threshold`` apart."""
    return tree.where((F.col("gap") <= threshold) & (F.col("parent_gap") > threshold)).select(
        "entity", "first_ts", "first_id", "first_ref", "last_ts", "last_id", "n"
    )


def current_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per (chat_id, msg_id): that of the highest ``id``.

    Ties of ``id`` are decided by the largest remaining values, a null id is the
    lowest. Rows with a null chat_id or msg_id name no message and are left out.
    """
    value = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("v"), *columns)
    best = messages.dropna(subset=["chat_id", "msg_id"]).groupBy("chat_id", "msg_id").agg(F.max(value).alias("m"))
    return best.select("chat_id", "msg_id", *[F.col(f"m.{c}").alias(c) for c in columns])


def _bridge(segments: DataFrame) -> DataFrame:
    """Joins segments whose opening reply points into the session that precedes them.

    ``segments``: entity, first_ts, first_id, target_ts, target_id (null: the
    segment opens a session for certain), last_ts, last_id, n. A segment s is
    joined to the running session if its target is not before that session's
    first event. If s opens a session, the next session opens at the first later
    segment whose target lies before s; so a chunk maps the session start it is
    entered with to the one it is left with, a step function whose steps are the
    running minima of the targets. Those steps are all that is carried over.
    """
    low = -(2**62)
    chunks = ordered_chunks(
        segments.withColumn("target_ts", F.coalesce("target_ts", F.lit(low))).withColumn("target_id", F.coalesce("target_id", F.lit(low))),
        ["entity"], ["first_ts", "first_id"],
    )

    def keys(table: pa.Table, a: str, b: str) -> list[tuple[int, int]]:
        return list(zip(table.column(a).to_pylist(), table.column(b).to_pylist()))

    def follow(start: tuple[int, int] | None, opens: list, targets: list) -> tuple[list[tuple[int, int]], tuple[int, int]]:
        owner = []
        for key, target in zip(opens, targets):
            if start is None or target < start:
                start = key
            owner.append(start)
        return owner, start

    steps_schema = "entity bigint, chunk int, step int, t_ts bigint, t_id bigint, out_ts bigint, out_id bigint"

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (entity,), table, first, last in runs(batches, ["entity"]):
            if not (first or last):
                continue
            chunk = chunk_of(table)
            opens, targets = keys(table, "first_ts", "first_id"), keys(table, "target_ts", "target_id")
            # next[i]: the next opening segment if i opens one, found from the right over a stack of falling targets
            after = [0] * len(opens)
            stack: list[int] = []
            for i in range(len(opens) - 1, -1, -1):
                a, b = 0, len(stack)  # stack: indices from far to near, targets rising towards the far end are dropped
                while a < b:  # the nearest k > i with target below opens[i]; targets fall from near to far
                    m = (a + b) // 2
                    if targets[stack[m]] < opens[i]:
                        a = m + 1
                    else:
                        b = m
                after[i] = stack[a - 1] if a else -1
                while stack and targets[stack[-1]] >= targets[i]:
                    stack.pop()
                stack.append(i)
            final = [0] * len(opens)
            for i in range(len(opens) - 1, -1, -1):
                final[i] = i if after[i] < 0 else final[after[i]]
            best = None
            k = 0
            for i, target in enumerate(targets):
                if best is None or target < best:
                    best = target
                    rows.append((entity, chunk, k, *target, *opens[final[i]]))
                    k += 1
        if rows:
            names = [c.split()[0] for c in steps_schema.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        start: tuple[int, int] | None = None
        out = []
        for chunk, part in pdf.sort_values(["chunk", "step"]).groupby("chunk"):
            if start is not None:
                out.append((part["entity"].iloc[0], chunk, *start))
            for s in part.itertuples():
                if start is None or (s.t_ts, s.t_id) < start:
                    start = (s.out_ts, s.out_id)
                    break
        return pd.DataFrame(out, columns=["entity", "chunk", "in_ts", "in_id"])

    entered = chunks.mapInArrow(steps, steps_schema).groupBy("entity").applyInPandas(enter, "entity bigint, chunk int, in_ts bigint, in_id bigint")
    # at most one row per partition: only a partition's first run is entered with a session
    starts = {(r.entity, r.chunk): (r.in_ts, r.in_id) for r in entered.collect()}
    share = chunks.sparkSession.sparkContext.broadcast(starts)

    names = ["entity", "first_ts", "first_id", "last_ts", "last_id", "n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (entity,), table, first, _ in runs(batches, ["entity"]):
            chunk = chunk_of(table)
            opens, targets = keys(table, "first_ts", "first_id"), keys(table, "target_ts", "target_id")
            owner, _ = follow(share.value.get((entity, chunk)) if first else None, opens, targets)
            a = np.array(owner, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), entity, dtype=np.int64)), pa.array(a[:, 0]), pa.array(a[:, 1]),
                 *[table.column(c).combine_chunks() for c in ("last_ts", "last_id", "n")]],
                names=names,
            )

    owned = chunks.mapInArrow(assign, ", ".join(f"{c} bigint" for c in names))
    return (
        owned.groupBy("entity", "first_ts", "first_id")
        .agg(F.max(F.struct("last_ts", "last_id")).alias("end"), F.sum("n").alias("n"))
        .select("entity", "first_ts", "first_id", F.col("end.last_ts").alias("last_ts"), F.col("end.last_id").alias("last_id"), "n")
    )


def sessions(messages: DataFrame, gap: int = 1800, carry_replies: bool = True) -> DataFrame:
    """The sessions of each chat: chat_id, first_msg, last_msg, start_ts, end_ts, duration, messages.

    Each message counts once, in order of (ts, msg_id). A message opens a session
    if it comes more than ``gap`` seconds after the one before it and, with
    ``carry_replies``, its ``reply_to`` isn't a message already in the session.

    ``messages`` needs id, chat_id, msg_id, reply_to, ts; other columns are
    ignored. Rows with a null chat_id, msg_id or ts are left out; repeated
    deliveries count once; a reply to itself, to a later message, to another
    chat's or to none doesn't carry. An empty table gives no session.
    """
    current = current_messages(messages, "ts", "reply_to")
    events = cut_lineage(current.select(F.col("chat_id").alias("entity"), "ts", F.col("msg_id").alias("id"), F.col("reply_to").alias("ref")))
    segments = cut_tree(gap_tree(events, at=gap), gap)
    if carry_replies:
        # only replies that open a segment look up their target
        asks = segments.where("first_ref is not null").select("entity", F.col("first_ref").alias("id")).distinct()
        targets = events.join(asks, ["entity", "id"], "left_semi").select("entity", F.col("id").alias("first_ref"), F.col("ts").alias("target_ts"))
        found = segments.join(targets, ["entity", "first_ref"], "left").withColumn("target_id", F.col("first_ref"))
        earlier = (F.col("target_ts") < F.col("first_ts")) | ((F.col("target_ts") == F.col("first_ts")) & (F.col("target_id") < F.col("first_id")))
        found = found.withColumn("target_id", F.when(earlier, F.col("target_id"))).withColumn("target_ts", F.when(earlier, F.col("target_ts")))
        segments = _bridge(found.select("entity", "first_ts", "first_id", "target_ts", "target_id", "last_ts", "last_id", "n"))
    return segments.select(
        F.col("entity").alias("chat_id"),
        F.col("first_id").alias("first_msg"),
        F.col("last_id").alias("last_msg"),
        F.col("first_ts").alias("start_ts"),
        F.col("last_ts").alias("end_ts"),
        (F.col("last_ts") - F.col("first_ts")).alias("duration"),
        F.col("n").alias("messages"),
    )
