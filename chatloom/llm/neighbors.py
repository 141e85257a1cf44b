"""The k most similar vectors of every vector.

An inverted-file index (spherical k-means cells) with adaptive dimension scans:

1. Vectors are brought to unit length, exact copies are folded into classes,
   and one random rotation spreads the distance evenly over the dimensions.
2. Cells are packed into units of bounded size, near cells together. A vector
   visits the units of its ``probes`` nearest cells, once per unit. Up to 4,096
   cells are fitted in one place; more by a second level: each part of the space
   that the first level makes is cut into cells by a task of its own.
3. In a unit, the rows of a probed cell are held in column blocks. After each
   block a hypothesis test on the partial distance, scaled to all dimensions,
   abandons the rows that can't come under the visitor's threshold, the k-th
   distance within its own cell. Survivors get the remaining blocks, and the
   similarity that comes out is the full one.

How many cells are probed, and how sure the test must be, is measured, not
guessed: for a sample of vectors their exact neighbours among all rows are
found, and it is counted how many lie in a probed cell and pass the test. The
settings are the cheapest whose recall is at least the one asked for, at the
lower end of its confidence interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import cut_lineage, parallelism

K = 10
DIM = 64
BLOCK = 16  # dimensions per column block
EPSILONS = (2.1, 2.5, 3.0, 3.6, 4.4, 6.0, 12.0)  # of the hypothesis test, from quick to sure
TRAIN = 65_536  # vectors the cells are fitted on, at most (in expectation)
TUNE = 512  # vectors the settings are measured on
Z = 2.33  # standard deviations: in 99 of 100 cases the recall is no less
MOST_FLAT = 4_096  # cells that are fitted in one place
MOST_CELLS = 65_536  # cells: their centres, 17 MB, go to every worker
PER_CELL = 32  # sampled vectors for each cell of the second level
LEAST_UNIT, UNIT_ROWS = 2_048, 16_384
VISITS = 65_536  # visitors of a unit before it is given to several tasks
SEED = 20_240_501


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int = DIM) -> DataFrame:
    """(id, vec) of the rows whose vector can be compared, one per id.

    Left out are null ids and vectors that are null, of another size, all zero
    or hold a null, a NaN or an infinity. If an id has several usable vectors,
    the least in array order counts.
    """
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col(id_col).isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.where(good).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix, dtype=np.float32)
    size = data.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def rotation(dim: int = DIM) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0].astype(np.float32)


def _units(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, cls, vec): the rotated unit vector, packed, and a 128-bit key of its direction."""
    turn = rotation(dim)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # the largest floats squared would overflow
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = np.round(x, 6).astype(np.float32) + np.float32(0)
            cls = [xxhash.xxh3_128_digest(row.tobytes()) for row in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), _packed(x.astype(np.float32) @ turn)], names=["id", "cls", "vec"])

    return vectors.mapInArrow(fn, "id bigint, cls binary, vec binary")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // len(centres))
    return np.concatenate([(x[low : low + step] @ centres.T).argmax(1) for low in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def _fit_cells(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample; an empty cell keeps its last centre."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres).astype(np.float32)
    return centres


def _fit_levels(base: DataFrame, sample: np.ndarray, n: int, cells: int, dim: int) -> np.ndarray:
    """Centres of many cells: parts by k-means on the sample, then the cells of each part by a task that gets a sample of the part.

    A part gets cells in proportion to its rows, and so many rows that there are
    ``PER_CELL`` for each cell in expectation, at most ``TRAIN``.
    """
    parts = int(np.sqrt(cells))
    tops = _fit_cells(sample, parts)
    share = np.bincount(_nearest(sample, tops), minlength=parts) / len(sample)
    wanted = np.maximum(1, np.round(share * cells)).astype(int)
    rate = np.minimum(1.0, np.minimum(PER_CELL * wanted, TRAIN) / np.maximum(1.0, share * n))
    level = base.sparkSession.sparkContext.broadcast((tops, wanted, rate))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, _, rate = level.value
        for batch in batches:
            if batch.num_rows:
                part = _nearest(_matrix(batch.column(0), dim), tops)
                kept = batch.column(1).to_numpy() < rate[part]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.array(part[kept].astype(np.int32))], names=["vec", "part"])

    def fit(table: pa.Table) -> pa.Table:
        rows = _matrix(table.column("vec"), dim)
        part = table.column("part")[0].as_py()
        return pa.table({"vec": _packed(_fit_cells(rows, min(len(rows), int(level.value[1][part]))))})

    draws = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = base.select("vec", draws.alias("u")).mapInArrow(draw, "vec binary, part int")
    return _matrix(drawn.groupBy("part").applyInArrow(fit, "vec binary").toArrow().column("vec"), dim)


def _pack(centres: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells into units of about ``most`` rows: per cell the first unit and the number of shards.

    Cells are grouped by k-means over their centres, groups that are too large
    again, so that the cells a vector probes lie in few units. A cell that alone
    is larger is cut into shards, each a unit.
    """
    first, shards = np.zeros(len(counts), dtype=np.int32), np.ones(len(counts), dtype=np.int32)
    unit = 0
    todo = [np.arange(len(counts))]
    while todo:
        part = todo.pop()
        total = counts[part].sum()
        if total <= most or len(part) == 1:
            first[part] = unit
            if len(part) == 1:
                shards[part] = max(1, -(-int(total) // most))
            unit += int(shards[part[0]]) if len(part) == 1 else 1
            continue
        groups = int(min(64, len(part), max(2, round(1.5 * total / most))))
        near = _nearest(centres[part], _fit_cells(centres[part], groups, 12))
        cut = [part[near == g] for g in range(groups) if (near == g).any()]
        if len(cut) == 1:  # centres that are all alike
            cut = [part[: len(part) // 2], part[len(part) // 2 :]]
        todo += reversed(cut)
    return first, shards, unit


def _top(owner: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best entries of each owner, ties by the smaller id."""
    order = np.lexsort((ids, -sim, owner))
    o = owner[order]
    start = np.ones(len(o), dtype=bool)
    start[1:] = o[1:] != o[:-1]
    index = np.arange(len(o))
    rank = index - np.maximum.accumulate(np.where(start, index, 0))
    return order[rank < k]


def _allowed(end: int, dim: int, epsilon: float) -> float:
    """The share of a squared distance that ``end`` dimensions may hold before a row is abandoned."""
    return end / dim * (1 + epsilon / np.sqrt(end)) ** 2


def scan(q: np.ndarray, q2: np.ndarray, x: np.ndarray, x2: np.ndarray, bound: np.ndarray, epsilon: float = EPSILONS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row, similarity) with squared distance <= bound[query], by column blocks.

    q2 and x2 hold the squared norms of the leading d dimensions for each block
    end d. Dense blocks while many pairs survive, then only the survivors.
    """
    dim = q.shape[1]
    dots = np.zeros((len(q), len(x)), dtype=np.float32)
    done = 0
    for step, end in enumerate(range(BLOCK, dim, BLOCK)):
        dots += q[:, done:end] @ x[:, done:end].T
        done = end
        limit = bound * _allowed(end, dim, epsilon)
        alive = dots >= ((q2[:, step] - limit)[:, None] + x2[:, step][None, :]) * 0.5
        if alive.mean() < 0.2:
            a, b = alive.nonzero()
            part = dots[a, b]
            for begin in range(done, dim, BLOCK):
                stop = begin + BLOCK
                part = part + np.einsum("ij,ij->i", q[a, begin:stop], x[b, begin:stop])
                if stop < dim:
                    at = stop // BLOCK - 1
                    limit = bound[a] * _allowed(stop, dim, epsilon)
                    keep = q2[a, at] + x2[b, at] - 2 * part <= limit
                    a, b, part = a[keep], b[keep], part[keep]
            keep = 2 - 2 * part <= bound[a]
            return a[keep], b[keep], part[keep]
    dots += q[:, done:] @ x[:, done:].T
    a, b = (dots >= (1 - bound / 2)[:, None]).nonzero()
    return a, b, dots[a, b]


def _prefix_norms(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.square(x), axis=1)[:, BLOCK - 1 :: BLOCK]


def _exact_top(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, dim: int) -> DataFrame:
    """(q, id, sim): the exact k best rows of each query, over all rows, in blocks."""
    share = rows.sparkSession.sparkContext.broadcast((queries, query_ids))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid = share.value
        owner, sims, ids = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, xid = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            for low in range(0, len(q), 1024):
                s = q[low : low + 1024] @ x.T
                s[qid[low : low + 1024][:, None] == xid[None, :]] = -2
                m = min(k, s.shape[1])
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                owner = np.concatenate([owner, np.repeat(np.arange(low, low + len(s)), m)])
                sims = np.concatenate([sims, np.take_along_axis(s, best, 1).ravel()])
                ids = np.concatenate([ids, xid[best].ravel()])
            keep = _top(owner, sims, ids, k)
            owner, sims, ids = owner[keep], sims[keep], ids[keep]
        keep = sims > -2
        yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(ids[keep]), pa.array(sims[keep].astype(np.float32))], names=["q", "id", "sim"])

    best = rows.select("id", "vec").mapInArrow(fn, "q bigint, id bigint, sim float")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _tune(base: DataFrame, queries: np.ndarray, query_ids: np.ndarray, centres: np.ndarray, k: int, dim: int, recall: float) -> tuple[int, float]:
    """How many cells to probe, and the epsilon of the test.

    In one pass over all rows each task keeps, for each sampled query, its k best
    rows with their cell and partial distances, and the k best of the query's own
    cell, which give its threshold.
    """
    ends = list(range(BLOCK, dim, BLOCK))
    share = base.sparkSession.sparkContext.broadcast((queries, query_ids, centres, _nearest(queries, centres)))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid, c, own = share.value
        held = {kind: (np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(ends)), np.float32)) for kind in (0, 1)}
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = batch.slice(start, 4096)
                x, xid = _matrix(piece.column(1), dim), piece.column(0).to_numpy()
                cell = _nearest(x, c)
                s = q @ x.T
                s[qid[:, None] == xid[None, :]] = -2
                for kind in (0, 1):
                    t = s if not kind else np.where(own[:, None] == cell[None, :], s, -2)
                    m = min(k, t.shape[1])
                    best = np.argpartition(-t, m - 1, axis=1)[:, :m]
                    owner, row = np.repeat(np.arange(len(q)), m), best.ravel()
                    sim = t[owner, row]
                    good = sim > -2
                    owner, row, sim = owner[good], row[good], sim[good]
                    partial = np.stack([np.square(q[owner, :e] - x[row, :e]).sum(1) for e in ends], axis=1) if ends else np.empty((len(row), 0), np.float32)
                    both = [np.concatenate(pair) for pair in zip(held[kind], (owner, sim, xid[row], cell[row], partial))]
                    keep = _top(both[0], both[1], both[2], k)
                    held[kind] = tuple(v[keep] for v in both)
        for kind, (owner, sim, ids, cell, partial) in held.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * len(ends)), pa.array(partial.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(owner), kind, np.int32)), pa.array(owner), pa.array(ids), pa.array(sim.astype(np.float32)), pa.array(cell.astype(np.int32)), lists],
                names=["kind", "q", "id", "sim", "cell", "partial"],
            )

    found = base.select("id", "vec").mapInArrow(fn, "kind int, q bigint, id bigint, sim float, cell int, partial array<float>")
    rank = F.row_number().over(Window.partitionBy("kind", "q").orderBy(F.desc("sim"), "id"))
    best = found.withColumn("r", rank).where(F.col("r") <= k).select("kind", "q", "sim", "cell", "partial").toPandas()  # 2 * TUNE * k rows at most
    order = np.argsort(-(queries @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    own = best[best["kind"] == 1].groupby("q")["sim"].agg(["count", "min"])
    bound = np.full(len(queries), 4.0)
    full = own[own["count"] >= k]
    bound[full.index.to_numpy()] = 2 - 2 * full["min"].to_numpy() + 1e-5
    true = best[best["kind"] == 0]
    q = true["q"].to_numpy()
    depth = place[q, true["cell"].to_numpy()]
    partial = np.stack(true["partial"].to_numpy()) if len(true) and ends else np.empty((len(true), 0))
    size = np.maximum(np.bincount(q, minlength=len(queries)), 1)

    def least(hit: np.ndarray) -> float:
        """The lower end of the recall's confidence interval, over the queries."""
        each = np.bincount(q, weights=hit, minlength=len(queries)) / size
        return each.mean() - Z * each.std() / np.sqrt(len(each))

    goal = min(recall, 1.0)
    for epsilon in EPSILONS:
        passes = (partial <= bound[q, None] * np.array([_allowed(e, dim, epsilon) for e in ends])[None, :]).all(1)
        if least(passes) >= goal + 0.7 * (1 - goal) or epsilon == EPSILONS[-1]:
            break
    low, high = min(8, len(centres)), len(centres)
    while low < high:
        middle = (low + high) // 2
        if least(passes & (depth < middle)) >= goal:
            high = middle
        else:
            low = middle + 1
    return low, epsilon


def similar_classes(base: DataFrame, k: int = K, dim: int = DIM, recall: float = 0.95) -> DataFrame:
    """(id, other, sim): the k nearest other rows of each row of ``base`` (id, vec: packed, rotated, distinct)."""
    spark = base.sparkSession
    n = base.count()
    if n < 2:
        return spark.createDataFrame([], "id bigint, other bigint, sim float")
    cells = int(max(1, min(MOST_CELLS, 4 * np.sqrt(n), n / 25)))
    sampled = base if n <= TRAIN else base.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n)) < TRAIN)
    sample = _matrix(sampled.select("vec").toArrow().column("vec"), dim)
    centres = _fit_cells(sample, min(cells, len(sample))) if cells <= MOST_FLAT else _fit_levels(base, sample, n, cells, dim)
    cells = len(centres)
    # from all rows, as those the cells were fitted on lie nearer to their centres than others
    asked = base.where(F.pmod(F.xxhash64("id", F.lit(SEED + 2)), F.lit(n)) < TUNE).select("id", "vec").toArrow()
    if not asked.num_rows:
        asked = base.orderBy("id").limit(TUNE).select("id", "vec").toArrow()
    probes, epsilon = _tune(base, _matrix(asked.column("vec"), dim), asked.column("id").to_numpy(), centres, k, dim, recall)
    counts = np.bincount(_nearest(sample, centres), minlength=cells) * (n / len(sample))
    centred = spark.sparkContext.broadcast(centres)

    tasks = parallelism(spark)
    first, shards, units = _pack(centres, counts, max(LEAST_UNIT, min(UNIT_ROWS, n // tasks)))
    plan = spark.sparkContext.broadcast((first, shards))
    spread = min(units, 4 * tasks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, many = plan.value
        for batch in batches:
            if batch.num_rows:
                ids, cell = batch.column(0).to_numpy(), _nearest(_matrix(batch.column(1), dim), centred.value)
                unit = begin[cell] + ids % many[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(unit.astype(np.int32))], names=["id", "vec", "cell", "unit"])

    placed = base.select("id", "vec").mapInArrow(place, "id bigint, vec binary, cell int, unit int")
    placed = cut_lineage(placed.repartition(spread, "unit").sortWithinPartitions("unit", "cell"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Thresholds within a row's own cell and shard; one visit per unit that holds a probed cell."""
        begin, many = plan.value
        c = centred.value
        offsets = [np.arange(f, f + s) for f, s in zip(begin.tolist(), many.tolist())]
        simple = bool((many == 1).all())

        def emit(x: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            s = x @ x.T
            np.fill_diagonal(s, -2)
            if len(x) > k:
                bound = 2 - 2 * np.partition(s, -k, axis=1)[:, -k] + 1e-5
            else:
                bound = np.full(len(x), 4.0)
            for low in range(0, len(x), 1024):
                part = x[low : low + 1024]
                near = part @ c.T
                p = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(part), 1))
                q = np.repeat(np.arange(len(part)), p.shape[1])
                cell = p.ravel()
                if simple:
                    unit = begin[cell]
                else:
                    lists = [offsets[j] for j in cell.tolist()]
                    sizes = np.array([len(a) for a in lists])
                    unit, q, cell = np.concatenate(lists), np.repeat(q, sizes), np.repeat(cell, sizes)
                by = np.lexsort((cell, unit, q))
                q, unit, cell = q[by], unit[by], cell[by]
                head = np.ones(len(q), dtype=bool)
                head[1:] = (q[1:] != q[:-1]) | (unit[1:] != unit[:-1])
                starts = head.nonzero()[0]
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                who = q[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit[starts].astype(np.int32)), pa.array(ids[low : low + 1024][who]), _packed(part[who]),
                     pa.array(bound[low : low + 1024][who].astype(np.float32)), lists],
                    names=["unit", "id", "vec", "bound", "cells"],
                )

        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            x, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            for low in range(0, len(x), 4096):  # a threshold within a part of a cell is one as well
                yield from emit(x[low : low + 4096], ids[low : low + 4096])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, cell = batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy()
            edges = [0, *((cell[1:] != cell[:-1]).nonzero()[0] + 1).tolist(), len(cell)]
            for low, high in zip(edges, edges[1:]):
                if held and at != cell[low]:
                    yield from flush()
                    held = []
                at = cell[low]
                held.append((low, x[low:high], ids[low:high]))
                if sum(len(h[1]) for h in held) >= UNIT_ROWS:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    visiting = cut_lineage(placed.select("id", "vec", "cell").mapInArrow(visits, "unit int, id bigint, vec binary, bound float, cells array<int>"))
    busy = visiting.groupBy("unit").count().collect()  # a row per unit: n / UNIT_ROWS at the least fill
    most = max(LEAST_UNIT, min(VISITS, sum(r["count"] for r in busy) // (2 * tasks)))
    copies = [(r["unit"], -(-r["count"] // most)) for r in busy]
    tasks_of = spark.createDataFrame(copies, "unit int, copies int")

    residents = placed.join(F.broadcast(tasks_of), "unit").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    residents = residents.select("unit", "part", F.lit(0).alias("kind"), "id", "vec", F.lit(0.0).cast("float").alias("bound"), F.array("cell").alias("cells"))
    guests = visiting.join(F.broadcast(tasks_of), "unit").withColumn("part", F.pmod(F.xxhash64("id"), F.col("copies").cast("bigint")).cast("int"))
    guests = guests.select("unit", "part", F.lit(1).alias("kind"), "id", "vec", "bound", "cells")
    mixed = residents.unionByName(guests).repartition(4 * spread, "unit", "part").sortWithinPartitions("unit", "part", "kind", F.col("cells")[0])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        parts: list[tuple] = []
        ready = None

        def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, x2, xid, cell_of = ready
            q, qid, bound = _matrix(batch.column(4), dim), batch.column(3).to_numpy(), batch.column(5).to_numpy()
            q2 = _prefix_norms(q)
            lists = batch.column(6)
            who = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            cell = lists.flatten().to_numpy()
            by = np.argsort(cell, kind="stable")
            who, cell = who[by], cell[by]
            edges = [0, *((cell[1:] != cell[:-1]).nonzero()[0] + 1).tolist(), len(cell)]
            owner, sims, ids = [], [], []
            for low, high in zip(edges, edges[1:]):
                a, b = cell_of.get(int(cell[low]), (0, 0))
                if a == b:
                    continue
                mine = who[low:high]
                i, j, s = scan(q[mine], q2[mine], x[a:b], x2[a:b], bound[mine], epsilon)
                owner.append(mine[i])
                sims.append(s)
                ids.append(xid[a + j])
            if not owner:
                return
            owner, sims, ids = np.concatenate(owner), np.concatenate(sims), np.concatenate(ids)
            keep = qid[owner] != ids
            owner, sims, ids = owner[keep], sims[keep], ids[keep]
            keep = _top(owner, sims, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(qid[owner[keep]]), pa.array(ids[keep]), pa.array(sims[keep].astype(np.float32))], names=["id", "other", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = [0, *((key[:, 1:] != key[:, :-1]).any(0).nonzero()[0] + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                unit, part, kind = key[:, low].tolist()
                piece = batch.slice(low, high - low)
                if (unit, part) != at:
                    at, parts, ready = (unit, part), [], None
                if kind == 0:
                    parts.append((_matrix(piece.column(4), dim), piece.column(3).to_numpy(), piece.column(6).flatten().to_numpy()))
                    continue
                if not parts and ready is None:
                    continue
                if ready is None:
                    x, xid, cell = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    by = np.argsort(cell, kind="stable")
                    x, xid, cell = x[by], xid[by], cell[by]
                    names, starts = np.unique(cell, return_index=True)
                    ends = [*starts[1:].tolist(), len(cell)]
                    ready = (x, _prefix_norms(x), xid, {int(c): (int(a), b) for c, a, b in zip(names, starts, ends)})
                    parts = []
                yield from compare(piece)

    found = mixed.mapInArrow(search, "id bigint, other bigint, sim float")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def most_similar(vectors: DataFrame, id_col: str = "window_id", vec_col: str = "vec", k: int = K, dim: int = DIM, recall: float = 0.95) -> DataFrame:
    """The k other ids with the most similar vectors: ``id, other, rank, similarity``.

    Unusable vectors (see ``usable``) neither ask nor answer. Vectors of one
    direction, to six decimals, form a class: its members are each other's first
    neighbours with similarity 1, and a class's neighbours are found once.
    Ties are ordered by the smaller id. Fewer than k rows come out where there
    are fewer other vectors; an empty table gives none.
    """
    units = cut_lineage(_units(usable(vectors, id_col, vec_col, dim), dim))
    base = cut_lineage(units.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("vec").alias("vec")))
    pairs = similar_classes(base, k, dim, recall)

    # the first k + 1 members of each class with copies; the rank is limited before the shuffle
    copied = base.where("n > 1").select("cls", F.col("id").alias("rep"))
    members = cut_lineage(units.select("id", "cls").join(copied, "cls").select("id", "rep"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    heads = members.withColumn("r", rank).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))

    wide = pairs.join(heads.withColumnRenamed("rep", "other"), "other", "left").select("id", F.coalesce("member", "other").alias("other"), "sim")
    own = heads.select(F.col("rep").alias("id"), F.col("member").alias("other"), F.lit(1.0).cast("float").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    lists = wide.unionByName(own).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    single = lists.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
    shared = (
        lists.groupBy("id").agg(F.collect_list(F.struct("other", "sim")).alias("near")).withColumnRenamed("id", "rep")
        .join(members, "rep").select("id", F.explode("near").alias("x")).select("id", "x.other", "x.sim")
    )
    every = single.unionByName(shared).where("id <> other").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return every.select("id", "other", "rank", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sim").cast("double"))).alias("similarity"))


def measured_recall(vectors: DataFrame, id_col: str = "window_id", vec_col: str = "vec", k: int = K, dim: int = DIM, every: int = 50) -> DataFrame:
    """(queries, expected, found, recall) against brute force, for the ids divisible by ``every``.

    A neighbour counts as found if its similarity is at least that of the exact
    k-th, so that ties between copies don't count as losses. Queries are compared
    with all rows in blocks of 65,536.
    """
    got = most_similar(vectors, id_col, vec_col, k, dim).where(F.col("id") % every == 0)
    units = cut_lineage(_units(usable(vectors, id_col, vec_col, dim), dim))
    asked = units.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // 65_536))
    exact = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("id").to_numpy()
        top = _exact_top(units, _matrix(part.column("vec"), dim), ids, k, dim)
        names = units.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q bigint, qid bigint")
        mine = top.join(F.broadcast(names), "q").groupBy(F.col("qid").alias("id")).agg(F.min("sim").alias("least"), F.count("*").alias("want"))
        exact = mine if exact is None else exact.unionByName(mine)
    if exact is None:
        exact = units.sparkSession.createDataFrame([], "id bigint, least float, want bigint")
    hits = got.join(exact, "id").groupBy("id").agg(F.sum((F.col("similarity") >= F.col("least") - 1e-5).cast("long")).alias("hit"))
    return (
        exact.join(hits, "id", "left")
        .agg(F.count("*").alias("queries"), F.coalesce(F.sum("want"), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.least("want", F.coalesce("hit", F.lit(0)))), F.lit(0)).alias("found"))
        .withColumn("recall", F.when(F.col("expected") > 0, F.round(F.col("found") / F.col("expected"), 4)))
    )
