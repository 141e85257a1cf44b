"""Order-dependent work on keys of any size.

``ordered_chunks`` spreads rows over range partitions of (key, order), so that a
key that holds a third of all rows is spread over a third of the partitions.
Everything that has to be carried from one partition to the next is a summary
of at most one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import cut_lineage, parallelism


CHUNK = "__chunk"
CHUNK_ROWS = 500_000  # rows of a partition that a task may hold, however many there are in all


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by (keys, order), sorted, fixed, as a checkpoint, with its partition number ``__chunk``.

    The number travels as a column: what a task calls its own partition changes
    under a union. ``df`` is made once, and its rows say how many partitions there
    are: none has much more than ``CHUNK_ROWS``.
    """
    df = cut_lineage(df)
    n = partitions or max(parallelism(df.sparkSession), -(-df.count() // CHUNK_ROWS))
    columns = [*keys, *order]
    return cut_lineage(df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn(CHUNK, F.spark_partition_id()))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table, bool, bool]]:
    """Consecutive rows of equal ``keys`` of a sorted partition.

    Yields (key, rows, is the partition's first run, is its last run). Keys must
    not be null. One run is held in memory at a time.
    """
    pending: list[pa.Table] = []
    at: tuple | None = None
    first = True
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        changed = columns[0][1:] != columns[0][:-1]
        for column in columns[1:]:
            changed = changed | (column[1:] != column[:-1])
        starts = [0, *(changed.nonzero()[0] + 1).tolist(), table.num_rows]
        for low, high in zip(starts, starts[1:]):
            key = tuple(c[low].item() if hasattr(c[low], "item") else c[low] for c in columns)
            if at is not None and key != at:
                yield at, pa.concat_tables(pending), first, False
                pending, first = [], False
            at = key
            pending.append(table.slice(low, high - low))
    if at is not None:
        yield at, pa.concat_tables(pending), first, True


def partition_id() -> int:
    """The task's partition: for marks that are only compared within the job that makes them."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def chunk_of(table: pa.Table) -> int:
    return table.column(CHUNK)[0].as_py()


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with the 1-based rank of each row among the rows of its ``keys``.

    Equal to ``row_number() over (partition by keys order by order)``, without
    bringing a group into one task: each range partition numbers its own rows,
    and a row per partition and group that crosses a border carries the offsets.
    ``order`` must be unique within a group; keys and order must not be null.
    An empty input gives an empty result.
    """
    chunks = ordered_chunks(df, keys, order)
    schema = chunks.schema
    out_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        count = 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            fresh = np.zeros(rows, dtype=bool)
            for column in columns:
                fresh[1:] |= column[1:] != column[:-1]
            start = tuple(c[0] for c in columns)
            fresh[0] = last is None or start != last
            index = np.arange(rows, dtype=np.int64)
            base = np.where(fresh, index, 0)
            base = np.maximum.accumulate(base)
            rank = index - base + 1
            if not fresh[0]:
                head = int(fresh.argmax()) if fresh.any() else rows
                rank[:head] += count
            count = int(rank[-1])
            last = tuple(c[-1] for c in columns)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rank)],
                names=[*batch.schema.names, name],
            )

    ranked = chunks.mapInArrow(number, f"{out_fields}, `{name}` bigint")
    counts = ranked.groupBy(*keys, "__chunk").agg(F.max(name).alias("__n"))
    # a group of many chunks has one row per chunk here: at most one per partition
    span = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("__chunks", F.count("*").over(span))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .where((F.col("__chunks") > 1) & (F.col("__before") > 0))
        .select(*keys, "__chunk", "__before")
    )
    # only a partition's first group can have rows before it: at most one row per partition
    joined = ranked.join(F.broadcast(offsets), [*keys, "__chunk"], "left")
    return joined.select(
        *[F.col(f"`{f.name}`") for f in schema.fields if f.name != CHUNK],
        (F.col(name) + F.coalesce(F.col("__before"), F.lit(0))).alias(name),
    )


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], flag: str | None = None, inclusive: bool = False) -> DataFrame:
    """``df`` with, for each row, columns of the latest row before it of equal ``keys``; null where there is none.

    ``columns``: the new name of each column that is carried. ``flag``, a boolean
    column, says which rows are carried (all without it); ``inclusive`` counts the
    row itself. Null keys are equal to each other. Equal to a window over the
    keys, but no key has to fit into one task: of each partition a row at most
    goes on to the next.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x01")) for k in keys])  # numpy drops a NUL at the end
    chunks = ordered_chunks(df.withColumn("__k", key).withColumn("__f", F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)), ["__k"], order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(columns)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last key of a partition, whether it is the only one, and the last flagged row of it."""
        at, only, held, chunk = None, True, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(batch.schema.get_field_index("__k")).to_numpy(zero_copy_only=False)
            f = batch.column(batch.schema.get_field_index("__f")).to_numpy(zero_copy_only=False)
            only = only and bool((k == k[0]).all()) and at in (None, k[0])
            if k[-1] != at:
                held = None
            last = (f & (k == k[-1])).nonzero()[0]
            if len(last):
                held = batch.slice(int(last[-1]), 1).select(wanted)
            at, chunk = k[-1], batch.column(batch.schema.get_field_index(CHUNK))[0].as_py()
        if at is not None:
            values = held.columns if held is not None else [pa.nulls(1, t.type) for t in batch.schema if t.name in wanted]
            names = wanted if held is not None else [t.name for t in batch.schema if t.name in wanted]
            head = [pa.array([chunk], pa.int32()), pa.array([at]), pa.array([only]), pa.array([held is not None])]
            row = pa.RecordBatch.from_arrays([*head, *values], names=["__c", "__k", "__only", "__held", *names])
            yield row.select(["__c", "__k", "__only", "__held", *wanted])

    schema = "__c int, __k string, __only boolean, __held boolean, " + ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in wanted)
    rows = chunks.mapInArrow(tails, schema).toArrow().sort_by("__c").to_pylist()  # a row for each partition at most
    entered: dict[int, tuple[str, dict]] = {}
    carried: tuple[str, dict] | None = None
    for r in rows:
        if carried:
            entered[r["__c"]] = carried
        if r["__held"]:
            carried = (r["__k"], {c: r[c] for c in wanted})
        elif not (r["__only"] and carried and carried[0] == r["__k"]):
            carried = None
    share = chunks.sparkSession.sparkContext.broadcast(entered)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past: tuple[str, pa.RecordBatch] | None = None
        begun = False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(batch.schema.get_field_index("__k")).to_numpy(zero_copy_only=False)
            f = batch.column(batch.schema.get_field_index("__f")).to_numpy(zero_copy_only=False)
            source = batch.select(wanted)
            if not begun:
                begun = True
                known = share.value.get(batch.column(batch.schema.get_field_index(CHUNK))[0].as_py())
                if known:
                    past = (known[0], pa.RecordBatch.from_arrays([pa.array([known[1][c]], source.schema.field(c).type) for c in wanted], names=wanted))
            # row 0 of the pool is what came before the batch
            pool = pa.Table.from_batches([past[1].cast(source.schema) if past else pa.RecordBatch.from_arrays([pa.nulls(1, t.type) for t in source.schema], names=wanted), source])
            start = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            latest = np.maximum.accumulate(np.where(f, np.arange(n) + 1, 0))
            own = latest.copy()
            if not inclusive:
                latest = np.concatenate([[0], latest[:-1]])
            inside = latest > first
            before = (first == 0) & (past is not None and past[0] == k[0])
            pick = pa.array(np.where(inside, latest, 0), mask=~(inside | before))
            taken = pool.combine_chunks().take(pick)
            kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c in kinds]
            yield from pa.table([*(v for _, v in kept), *(taken.column(c) for c in wanted)], names=[*(c for c, _ in kept), *columns.values()]).combine_chunks().to_batches()
            if own[-1] > first[-1]:
                past = (k[-1], source.slice(int(own[-1]) - 1, 1))
            elif not (first[-1] == 0 and past is not None and past[0] == k[-1]):
                past = None

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return chunks.mapInArrow(fill, fields + "".join(f", `{new}` {kinds[c].simpleString()}" for c, new in columns.items()))
