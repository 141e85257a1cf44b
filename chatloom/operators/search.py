"""Hybrid search for batches of questions: BM25 over messages, cosine over windows, fused by reciprocal rank.

Every operator has the question id in its keys, so a batch of any size is one
plan. Filters on chats come before the ranking's cut, as they decide who is
ranked; filters on time and speaker come where the semantics say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.parsing import document_terms, query_tokens, words_in_order
from chatloom.session import cut_lineage

K1, B = 1.2, 0.75
TOP_K, RRF_K = 10, 20
WEIGHT_KEYWORD, WEIGHT_VECTOR = 0.7, 1.0
COMMON = 0.25  # a term in more than this share of the messages is dropped
OVERFETCH = 20
BLOCK = 65_536  # question vectors sent to the executors at a time
SLICE = 512  # of them compared with a batch at a time
HELD = 4_000_000  # hits that a task holds for the questions of a block
FEW_TOKENS = 200_000  # asked tokens that are sent to every worker; more are joined
CHUNK_ROWS = 1_000_000  # postings of whole documents that are searched at a time


# ---------------------------------------------------------------- term index


def postings(messages: DataFrame) -> DataFrame:
    """(term, chat_id, msg_id, tf, positions, length) of a table with a row per message."""
    terms = messages.select("chat_id", "msg_id", document_terms(F.col("text")).alias("terms"))
    each = terms.select("chat_id", "msg_id", F.size("terms").alias("length"), F.posexplode("terms").alias("pos", "term"))
    return each.groupBy("term", "chat_id", "msg_id").agg(
        F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.max("length").alias("length")
    )


def refresh_postings(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after some messages have changed: theirs are dropped and made anew, the rest is kept.

    ``changed`` has the current row of each changed message; a null text is a
    deleted one.
    """
    kept = index.join(changed.select("chat_id", "msg_id"), ["chat_id", "msg_id"], "left_anti")
    return kept.select("term", "chat_id", "msg_id", "tf", "positions", "length").unionByName(postings(changed))


def kept_size(messages: DataFrame, index: DataFrame) -> DataFrame:
    """``corpus_size`` by an index that is kept: no text is read."""
    terms = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))
    return messages.agg(F.count("*").alias("n")).join(terms).select("n", F.try_divide(F.col("terms").cast("double"), F.col("n")).alias("avg_length"))


def corpus_size(messages: DataFrame) -> DataFrame:
    """One row: n documents, avg_length in terms."""
    return messages.agg(F.count("*").alias("n"), F.avg(F.size(document_terms(F.col("text")))).alias("avg_length"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def question_phrases(questions: DataFrame) -> DataFrame:
    """(qid, phrase, times, size): the tokens of each question with their multiplicity; a phrase has several terms."""
    tokens = questions.select("qid", F.explode(query_tokens(F.col("question"))).alias("token"))
    phrases = tokens.groupBy("qid", "token").agg(F.count("*").alias("times")).withColumn("phrase", words_in_order(F.col("token")))
    return phrases.where(F.size("phrase") > 0).select("qid", "token", "phrase", "times", F.size("phrase").alias("size"))


def phrase_matches(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(token, chat_id, msg_id, f, length): the documents that hold each distinct token, and how often.

    A token of one term reads the postings; one of several needs its terms at
    consecutive positions. Up to ``FEW_TOKENS`` tokens are sent to the postings;
    more are joined to them by term.
    """
    distinct = cut_lineage(phrases.select("token", "phrase", "size").distinct())
    sizes = {r["size"]: r["n"] for r in distinct.groupBy((F.col("size") > 1).alias("size")).agg(F.count("*").alias("n")).collect()}
    hint = F.broadcast if sum(sizes.values()) <= FEW_TOKENS else lambda df: df
    one = index.join(hint(distinct.where("size = 1").select("token", F.col("phrase")[0].alias("term"))), "term").select("token", "chat_id", "msg_id", F.col("tf").alias("f"), "length")
    if not sizes.get(True):
        return one
    parts = distinct.where("size > 1").select("token", "size", F.posexplode("phrase").alias("offset", "term"))
    at = index.join(hint(parts), "term").select("token", "size", "offset", "chat_id", "msg_id", "length", F.explode("positions").alias("pos"))
    begun = at.groupBy("token", "size", "chat_id", "msg_id", "length", (F.col("pos") - F.col("offset")).alias("begin")).agg(F.countDistinct("offset").alias("met"))
    many = begun.where("met = size").groupBy("token", "chat_id", "msg_id", "length").agg(F.count("*").alias("f"))
    return one.unionByName(many.select(*one.columns))


def informative(phrases: DataFrame, matches: DataFrame, size: DataFrame, share: float = COMMON) -> DataFrame:
    """``phrases`` with ``df`` and ``n``, without those in more than ``share`` of the messages, unless none is left."""
    df = matches.groupBy("token").agg(F.count("*").alias("df"))
    counted = phrases.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).join(F.broadcast(size))
    kept = F.col("df") <= F.lit(share) * F.col("n")
    any_kept = F.max(kept.cast("int")).over(Window.partitionBy("qid"))
    return counted.withColumn("__kept", kept).withColumn("__any", any_kept).where("__kept or __any = 0").drop("__kept", "__any")


def bm25(questions: DataFrame, messages: DataFrame, index: DataFrame | None = None, chats: str | None = None) -> DataFrame:
    """(qid, chat_id, msg_id, score): BM25 of every message that holds a token of a question; higher is better.

    Statistics are those of the whole table. With ``chats``, a column of arrays
    of chat ids in ``questions`` limits whom a question may see; null is all.
    """
    index = postings(messages) if index is None else index
    size = corpus_size(messages)
    phrases = question_phrases(questions)
    matches = phrase_matches(phrases, index)
    terms = informative(phrases, matches, size)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * F.when(idf > 0, idf).otherwise(1e-6)
    saturated = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    hits = terms.select("qid", "token", weight.alias("weight"), "avg_length").join(matches, "token")
    if chats:
        hits = hits.join(questions.select("qid", F.col(chats).alias("__chats")), "qid").where(F.col("__chats").isNull() | F.array_contains("__chats", F.col("chat_id")))
    return hits.groupBy("qid", "chat_id", "msg_id").agg(F.sum(F.col("weight") * saturated).alias("score"))


def bm25_top(
    questions: DataFrame, messages: DataFrame, limit: int, index: DataFrame | None = None, chats: str | None = None, digits: int = 9, size: DataFrame | None = None,
) -> DataFrame:
    """(qid, chat_id, msg_id, score, rank): the ``limit`` best messages of each question by BM25, exact.

    The order is that of the score rounded to ``digits``, then chat_id, msg_id.
    Other than ``bm25`` this pairs no question with all messages that share a
    token: the postings of the asked tokens are laid out by message, and each
    task keeps the best hits of each question over its own messages. Per chunk of
    messages, what a token can add at most tells which tokens a new hit must have
    (MaxScore); the common ones are only looked up for candidates, and a question
    that can't gain from a chunk passes it by. Questions go to the tasks in
    blocks whose hits fit in memory; a token that a quarter of all messages hold
    is spread with them. ``size``: the row of ``corpus_size``, if it is kept.
    """
    spark = messages.sparkSession
    phrases = cut_lineage(question_phrases(questions))
    distinct = cut_lineage(phrases.select("token", "phrase").distinct())
    if index is None and distinct.count() <= FEW_TOKENS:
        matches = cut_lineage(_asked_by_message(messages, distinct))
    else:
        # by message: of postings that lie so already, as after an upsert, nothing is moved
        found = phrase_matches(phrases, postings(messages) if index is None else index)
        matches = cut_lineage(found.groupBy("chat_id", "msg_id").agg(F.max("length").alias("length"), F.collect_list("token").alias("tokens"), F.collect_list("f").alias("f")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * F.when(idf > 0, idf).otherwise(1e-6)
    terms = informative(phrases, matches.select(F.explode("tokens").alias("token")), corpus_size(messages) if size is None else size).where("df > 0").select("qid", "token", weight.alias("weight"), "avg_length")
    if chats:
        terms = terms.join(questions.select("qid", F.col(chats).alias("chats")), "qid")
    terms = cut_lineage(terms)
    asked = terms.select("qid").distinct().count()
    per_block = int(max(256, min(BLOCK, HELD // limit)))
    blocks = max(1, -(-asked // per_block))
    result = spark.createDataFrame([], "qid bigint, chat_id bigint, msg_id bigint, score double")
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid", "token").toArrow()
        if rows.num_rows:
            result = result.unionByName(matches.mapInArrow(_block_search(spark, rows, limit, digits), "qid bigint, chat_id bigint, msg_id bigint, score double"))
    return top(result, "qid", [F.desc("score"), F.col("chat_id"), F.col("msg_id")], limit)


def _asked_by_message(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(chat_id, msg_id, length, tokens, f) of the messages that hold one of few ``tokens`` (token, phrase), without an index.

    The same as by ``phrase_matches``: each message is cut into its terms and the
    asked ones are counted where it lies; nothing is moved.
    """
    asked = [(r["token"], r["phrase"]) for r in tokens.collect()]  # FEW_TOKENS at most
    share = messages.sparkSession.sparkContext.broadcast(
        ([t for t, p in asked if len(p) == 1], [p[0] for _, p in asked if len(p) == 1], [(t, p) for t, p in asked if len(p) > 1])
    )

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        names, single, several = share.value
        names = pa.array([*names, *(t for t, _ in several)], pa.string())
        place = {t: i for i, t in enumerate(single)}
        for _, phrase in several:
            for term in phrase:
                place.setdefault(term, len(place))
        vocabulary = pa.array(list(place), pa.string())
        firsts: dict[int, list[tuple[int, list[int]]]] = {}
        for k, (_, phrase) in enumerate(several, len(single)):
            firsts.setdefault(place[phrase[0]], []).append((k, [place[t] for t in phrase]))
        by_token = {place[t]: [] for t in single}
        for k, t in enumerate(single):
            by_token[place[t]].append(k)  # tokens such as "a" and "_a" have one term
        twins = any(len(v) > 1 for v in by_token.values())
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            if twins:
                reps = np.array([len(by_token.get(t, ())) for t in range(len(place))] + [0])
                hit = np.repeat(np.arange(len(term)), reps[term])
                flat = np.array([k for t in range(len(place)) for k in by_token.get(t, ())], dtype=np.int64)
                begin = np.concatenate([[0], np.cumsum(reps[:-1])])
                within = np.arange(len(hit)) - np.repeat(np.cumsum(reps[term]) - reps[term], reps[term])
                docs, tok = [row[hit]], [flat[begin[term[hit]] + within]]
            else:
                known = (term >= 0) & (term < len(single))
                docs, tok = [row[known]], [term[known]]
            if firsts:
                for t in np.intersect1d(term, np.array(list(firsts))):
                    at = (term == t).nonzero()[0]
                    for k, phrase in firsts[int(t)]:
                        ok = at[at + len(phrase) <= len(term)]
                        for j, part in enumerate(phrase[1:], 1):
                            ok = ok[(term[ok + j] == part) & (row[ok + j] == row[ok])]
                        docs.append(row[ok])
                        tok.append(np.full(len(ok), k))
            code, count = np.unique(np.concatenate(docs) * len(names) + np.concatenate(tok), return_counts=True)
            doc, tok = np.divmod(code, max(1, len(names)))
            held, start = np.unique(doc, return_index=True)
            offsets = pa.array(np.append(start, len(doc)).astype(np.int32))
            pick = pa.array(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(sizes[held].astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, names.take(pa.array(tok))), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64)))],
                names=["chat_id", "msg_id", "length", "tokens", "f"],
            )

    terms = messages.select("chat_id", "msg_id", document_terms(F.col("text")).alias("terms"))
    return terms.mapInArrow(fn, "chat_id bigint, msg_id bigint, length int, tokens array<string>, f array<bigint>")


def _block_search(spark, rows: pa.Table, limit: int, digits: int):
    """The search of one block of questions over a task's messages, for ``mapInArrow``."""
    token = rows.column("token").combine_chunks().dictionary_encode()
    qid = rows.column("qid").to_numpy()
    starts = np.append(np.concatenate([[0], (qid[1:] != qid[:-1]).nonzero()[0] + 1]), len(qid)).astype(np.int64)
    allowed = None
    if "chats" in rows.column_names:
        allowed = [None if c is None else np.array([x for x in c if x is not None], dtype=np.int64) for c in rows.column("chats").take(pa.array(starts[:-1])).to_pylist()]
    share = spark.sparkContext.broadcast(
        (token.dictionary.to_pylist(), token.indices.to_numpy(), rows.column("weight").to_numpy(), qid[starts[:-1]], starts, float(rows.column("avg_length")[0].as_py() or 1.0), allowed)
    )

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        words, asked, weights, qids, starts, average, allowed = share.value
        words = pa.array(words, pa.string())
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(qids)
        margin = 10.0**-digits

        def search(tok: np.ndarray, chat: np.ndarray, msg: np.ndarray, f: np.ndarray, length: np.ndarray) -> None:
            fresh = np.concatenate([[True], (chat[1:] != chat[:-1]) | (msg[1:] != msg[:-1])])
            doc_chat, doc_msg = chat[fresh], msg[fresh]
            gain = f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))
            by = np.argsort(tok, kind="stable")
            doc, gain = (np.cumsum(fresh) - 1)[by], gain[by]
            edge = np.searchsorted(tok[by], np.arange(len(words) + 1))
            held = edge[1:] > edge[:-1]
            most = np.zeros(len(words))
            most[held] = np.maximum.reduceat(gain, edge[:-1][held])
            for i in range(len(qids)):
                mine = asked[starts[i] : starts[i + 1]]
                here = held[mine]
                if not here.any():
                    continue
                mine, w = mine[here], weights[starts[i] : starts[i + 1]][here]
                past = best[i]
                floor = past[0][-1] - margin if past is not None and len(past[0]) == limit else -np.inf
                bound = w * most[mine]
                order = np.argsort(-bound, kind="stable")
                mine, w, bound = mine[order], w[order], bound[order]
                rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0.0]])  # what the tokens from here on can add
                if rest[0] < floor:
                    continue
                ok = None
                if allowed is not None and allowed[i] is not None:
                    ok = np.isin(doc_chat, allowed[i])
                    if not ok.any():
                        continue
                needed = int((rest[:-1] >= floor).sum())  # a hit has one of these
                parts = [slice(edge[t], edge[t + 1]) for t in mine]
                docs = np.concatenate([doc[p] for p in parts[:needed]])
                scores = np.concatenate([x * gain[p] for x, p in zip(w, parts[:needed])])
                if ok is not None:
                    docs, scores = docs[ok[docs]], scores[ok[docs]]
                if not len(docs):
                    continue
                if needed > 1:
                    docs, where = np.unique(docs, return_inverse=True)
                    scores = np.bincount(where, weights=scores)
                for j in range(needed, len(mine)):
                    keep = scores + rest[j] >= floor
                    docs, scores = docs[keep], scores[keep]
                    other = doc[parts[j]]
                    at = np.minimum(np.searchsorted(other, docs), len(other) - 1)
                    scores = scores + np.where(other[at] == docs, w[j] * gain[parts[j]][at], 0.0)
                scores = np.round(scores, digits)
                if len(scores) > limit:
                    keep = scores >= -np.partition(-scores, limit - 1)[limit - 1]
                    docs, scores = docs[keep], scores[keep]
                new = (scores, doc_chat[docs], doc_msg[docs])
                both = new if past is None else tuple(np.concatenate(pair) for pair in zip(past, new))
                first = np.lexsort((both[2], both[1], -both[0]))[:limit]
                best[i] = tuple(v[first] for v in both)

        pending: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            tok = pc.index_in(lists.flatten(), value_set=words)
            keep = pc.is_valid(tok).to_numpy(zero_copy_only=False)
            row = row[keep]
            chat, msg, length = (batch.column(j).to_numpy()[row] for j in range(3))
            pending.append((tok.to_numpy(zero_copy_only=False)[keep].astype(np.int64), chat, msg, batch.column(4).flatten().to_numpy()[keep], length))
            total += len(row)
            if total >= CHUNK_ROWS:
                search(*(np.concatenate(c) for c in zip(*pending)))
                pending, total = [], 0
        if total:
            search(*(np.concatenate(c) for c in zip(*pending)))
        for low in range(0, len(qids), 4096):
            part = [(q, b) for q, b in zip(qids[low : low + 4096], best[low : low + 4096]) if b is not None]
            if part:
                owner = np.concatenate([np.full(len(b[0]), q, dtype=np.int64) for q, b in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner), *(pa.array(np.concatenate([b[j] for _, b in part])) for j in (1, 2, 0))], names=["qid", "chat_id", "msg_id", "score"]
                )

    return fn


def top(df: DataFrame, key: str, order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key, numbered from 1; the limit is applied before the shuffle as well."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(name) <= limit)


def interval_join(points: DataFrame, intervals: DataFrame, key: str, point: str, low: str, high: str, width: int = 64) -> DataFrame:
    """Points within [low, high] of an interval of equal ``key``, by an equi-join on buckets.

    An interval is sent to each bucket it touches, so a busy key is spread over
    its buckets instead of being compared with all of its intervals. Buckets come
    in sizes of width, width * 64, and so on: an interval takes the size at which
    it touches 65 at most, however wide it is, and a point looks in one bucket of
    each size that is in use, a few at most.
    """
    span = F.greatest(F.col(high) - F.col(low), F.lit(0)).cast("double") / (width * 64)
    level = F.when(span < 1, 0).otherwise(F.floor(F.log(64.0, F.greatest(span, F.lit(1.0)))) + 1).cast("int")
    sized = intervals.where(F.col(low) <= F.col(high)).withColumn("__l", level).withColumn("__w", F.expr(f"{width} * shiftleft(1L, __l * 6)"))
    levels = sorted(r["__l"] for r in sized.select("__l").distinct().collect())  # eleven at most
    bucket = lambda c: F.floor(F.col(c) / F.col("__w"))
    spread = sized.withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high)))).drop("__w")
    placed = points.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    placed = placed.withColumn("__w", F.expr(f"{width} * shiftleft(1L, __l * 6)")).withColumn("__b", bucket(point)).drop("__w")
    return placed.join(spread, [key, "__l", "__b"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__b", "__l")


def windows_of_messages(ranked: DataFrame, windows: DataFrame) -> DataFrame:
    """(qid, window_id, rank): the best rank among the messages of each window; ``ranked`` has qid, chat_id, msg_id, rank."""
    spans = windows.select(F.col("id").alias("window_id"), "chat_id", "first_msg", "last_msg")
    return interval_join(ranked, spans, "chat_id", "msg_id", "first_msg", "last_msg").groupBy("qid", "window_id").agg(F.min("rank").alias("rank"))


def keyword_arm(questions: DataFrame, messages: DataFrame, windows: DataFrame, pool: int, index: DataFrame | None = None, ranges: DataFrame | None = None, chats: str | None = None, size: DataFrame | None = None) -> DataFrame:
    """(qid, window_id, rank): the ``pool`` best windows of each question by their best message.

    ``ranges`` (qid, start, end) limits the windows, after the cut of messages.
    """
    cut = bm25_top(questions, messages, pool * OVERFETCH, index, chats, size=size)
    found = windows_of_messages(cut.select("qid", "chat_id", "msg_id", "rank"), windows)
    if ranges is not None:
        times = windows.select(F.col("id").alias("window_id"), "ts_start", "ts_end")
        found = found.join(ranges, "qid", "left").join(times, "window_id").where("start is null or (ts_end >= start and ts_start <= end)").select("qid", "window_id", "rank")
    return top(found.withColumnRenamed("rank", "best"), "qid", [F.col("best"), F.col("window_id")], pool).select("qid", "window_id", "rank")


# ---------------------------------------------------------------- vectors


def usable_vectors(vectors: DataFrame, dim: int, id_col: str = "window_id", vec_col: str = "vec") -> DataFrame:
    """(window_id, vec) of the rows with ``dim`` finite numbers, not all zero; of several rows of an id the least vector."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col(id_col).isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.where(good).groupBy(F.col(id_col).alias("window_id")).agg(F.min(v).alias("vec"))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def knn(questions: DataFrame, vectors: DataFrame, limit: int, dim: int = 64, extra: list[str] | None = None) -> DataFrame:
    """(qid, window_id, score): the exact ``limit`` nearest vectors of each question by cosine, ties by id.

    ``questions``: qid, vec, and with ``extra`` = [chats, start, end] the chats it
    may see and the time it asks about (each nullable), which ``vectors`` then
    answers with chat_id, ts_start, ts_end. Question vectors go to the executors
    in blocks of 65,536; each task keeps its own best ``limit`` per question.
    """
    spark = vectors.sparkSession
    columns = ["qid", "vec", *(extra or [])]
    asked = questions.select(*columns)
    first = asked.limit(BLOCK + 1).toArrow()
    blocks = 1
    if first.num_rows > BLOCK:
        asked = cut_lineage(asked)
        blocks = -(-asked.count() // (BLOCK // 2))
    result = None
    for b in range(blocks):
        table = first if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        if not table.num_rows:
            continue
        qids = table.column("qid").to_numpy()
        matrix = _unit(table.column("vec").combine_chunks(), dim)
        limits = None
        if extra:
            lists = table.column(extra[0]).combine_chunks()
            sizes = np.array([-1 if not v else n for v, n in zip(lists.is_valid().to_pylist(), lists.value_lengths().to_pylist())])
            owner = np.repeat(np.arange(len(qids)), np.maximum(sizes, 0))
            chat = lists.flatten().to_numpy(zero_copy_only=False)
            least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            free = np.array([v is None for v in table.column(extra[1]).to_pylist()])
            times = [np.array([default if v is None else v for v in table.column(c).to_pylist()], dtype=np.int64) for c, default in ((extra[1], least), (extra[2], most))]
            limits = (sizes < 0, owner, chat, free, *times)
        share = spark.sparkContext.broadcast((qids, matrix, limits))

        def fn(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            qids, q, limits = share.value
            best_s = np.full((len(q), limit), -np.inf)
            best_i = np.zeros((len(q), limit), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = np.argsort(batch.column(0).to_numpy(), kind="stable")
                x, ids = _unit(batch.column(1), dim)[order], batch.column(0).to_numpy()[order]
                n = len(ids)
                if limits:
                    place, ts_start, ts_end = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (2, 3, 4))
                    chats, chat_of = np.unique(place, return_inverse=True)
                for low in range(0, len(q), SLICE):
                    s = np.round(q[low : low + SLICE] @ x.T, 6)
                    if limits:
                        high = min(low + SLICE, len(q))
                        every, owner, chat, free, start, end = limits
                        mine = slice(*np.searchsorted(owner, (low, high)))
                        at = np.minimum(np.searchsorted(chats, chat[mine]), len(chats) - 1)
                        may = np.repeat(every[low:high, None], len(chats), 1)
                        hit = chats[at] == chat[mine]
                        may[owner[mine][hit] - low, at[hit]] = True
                        seen = may[:, chat_of] & (free[low:high, None] | ((ts_end[None, :] >= start[low:high, None]) & (ts_start[None, :] <= end[low:high, None])))
                        s[~seen] = -np.inf
                    # one whole number per pair: the score, then the smaller id
                    rank = np.rint(np.where(np.isfinite(s), s, -9) * 1e6).astype(np.int64) * n + (n - 1 - np.arange(n))
                    m = min(limit, n)
                    near = np.argpartition(-rank, m - 1, axis=1)[:, :m]
                    both_s = np.concatenate([best_s[low : low + SLICE], np.take_along_axis(s, near, 1)], axis=1)
                    both_i = np.concatenate([best_i[low : low + SLICE], ids[near]], axis=1)
                    keep = np.lexsort((both_i, -both_s), axis=1)[:, :limit]
                    best_s[low : low + SLICE], best_i[low : low + SLICE] = np.take_along_axis(both_s, keep, 1), np.take_along_axis(both_i, keep, 1)
            keep = np.isfinite(best_s)
            owner = np.repeat(qids, keep.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["qid", "window_id", "score"])

        source = vectors.select("window_id", F.col("vec").cast("array<float>").alias("vec"), *(["chat_id", "ts_start", "ts_end"] if extra else []))
        found = source.mapInArrow(fn, "qid bigint, window_id bigint, score double")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "qid bigint, window_id bigint, score double")
    return top(result, "qid", [F.desc("score"), F.col("window_id")], limit)


def dot(a: Column, b: Column) -> Column:
    """Dot product as an expression, for single pairs of vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def pack(vec: Column) -> Column:
    """Little-endian float32 bytes of a vector, for interchange."""

    @F.pandas_udf("binary")
    def to_bytes(v):
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return to_bytes(vec)


def unpack(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def to_list(b):
        return b.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4").tolist())

    return to_list(blob)


# ---------------------------------------------------------------- fusion


def fuse(keyword: DataFrame, vector: DataFrame, k: int = RRF_K, weights: tuple[float, float] = (WEIGHT_KEYWORD, WEIGHT_VECTOR)) -> DataFrame:
    """(qid, window_id, score, kw_rank, vec_rank): the sum of weight / (k + rank) over both rankings."""
    both = keyword.select("qid", "window_id", F.col("rank").alias("kw_rank"), F.lit(None).cast("int").alias("vec_rank")).unionByName(
        vector.select("qid", "window_id", F.lit(None).cast("int").alias("kw_rank"), F.col("rank").alias("vec_rank"))
    )
    ranks = both.groupBy("qid", "window_id").agg(F.min("kw_rank").alias("kw_rank"), F.min("vec_rank").alias("vec_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return ranks.withColumn("score", part("kw_rank", weights[0]) + part("vec_rank", weights[1]))


def hybrid_search(
    questions: DataFrame, messages: DataFrame, windows: DataFrame, vectors: DataFrame, top_k: int = 0, pool: int | None = None,
    index: DataFrame | None = None, dim: int = 64, filter_first: bool = False, size: DataFrame | None = None,
) -> DataFrame:
    """The hits of each question: qid, rank, window_id, score, and the window's columns.

    ``questions``: qid, question, vec, and optionally chats (array, null: all),
    start and end (a closed range), speaker (part of the speakers, any case).
    ``top_k`` 0 means 10. As a rule time and speaker are applied after the best
    ``top_k`` are taken, so fewer may be left; ``filter_first`` applies them before.
    """
    top_k = top_k or TOP_K
    has = set(questions.columns)
    for name, kind in (("chats", "array<bigint>"), ("start", "bigint"), ("end", "bigint"), ("speaker", "string")):
        if name not in has:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    narrowed = bool(has & {"start", "end", "speaker"})
    pool = pool or top_k * (8 if narrowed else 4)
    ranges = questions.select("qid", "start", "end") if "start" in has else None
    keyword = keyword_arm(questions, messages, windows, pool, index, ranges, "chats" if "chats" in has else None, size)
    shown = windows.select(F.col("id").alias("window_id"), "chat_id", "first_msg", "last_msg", "ts_start", "ts_end", "speakers", "text")
    places = vectors.join(shown.select("window_id", "chat_id", "ts_start", "ts_end"), "window_id")
    near = knn(questions.where("vec is not null"), places, pool, dim, ["chats", "start", "end"] if has & {"chats", "start", "end"} else None)
    fused = fuse(keyword, near.select("qid", "window_id", "rank")).withColumn("score", F.round("score", 12))
    wanted = questions.select("qid", "chats", "start", "end", "speaker")

    def passing(rows: DataFrame) -> DataFrame:
        ok = (
            (F.col("chats").isNull() | F.array_contains("chats", F.col("chat_id")))
            & (F.col("start").isNull() | ((F.col("ts_end") >= F.col("start")) & (F.col("ts_start") <= F.col("end"))))
            & (F.col("speaker").isNull() | (F.col("speaker") == "") | F.contains(F.lower(F.coalesce("speakers", F.lit(""))), F.lower("speaker")))
        )
        return rows.join(wanted, "qid").where(ok).drop("chats", "start", "end", "speaker")

    order = [F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), F.col("window_id")]
    if filter_first:
        rows = top(passing(fused.join(shown, "window_id")), "qid", order, top_k)
    else:
        # the texts are joined to the few that are left
        rows = passing(top(fused, "qid", order, top_k).join(shown, "window_id"))
    return rows.select("qid", "rank", "window_id", "score", "chat_id", "first_msg", "last_msg", "ts_start", "ts_end", "speakers", "text")


def success_at_k(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, hit): whether all needles of a case are in its hits' texts, any case. A case without hits misses."""
    blob = hits.groupBy("qid").agg(F.lower(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]))).alias("blob"))
    joined = cases.join(blob, "qid", "left")
    return joined.select("qid", F.coalesce(F.forall("needles", lambda n: F.contains(F.col("blob"), F.lower(n))), F.lit(False)).alias("hit"))


def recall(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("recall"), F.count("*").alias("cases"))


PASSAGE, QUERY = "passage: ", "query: "  # fixed values: what models of this kind are told of a text's part


def encode_texts(texts: DataFrame, dim: int = 64, text_col: str = "text", out_col: str = "vec", encoder=None, prefix: str = "") -> DataFrame:
    """``texts`` with a unit vector of each text.

    ``prefix`` stands before each text for an ``encoder`` that wants it.

    ``encoder`` maps a list of strings to an array (n, dim) and is loaded once per
    task; without one, words and their neighbours are hashed to signed dimensions,
    which is deterministic and claims no understanding. An empty text gives zeros.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop(out_col).schema.fields) + f", `{out_col}` array<float>"
    texts = texts.drop(out_col)
    at = texts.columns.index(text_col)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder or hashing_encoder(dim)
        for batch in batches:
            x = np.asarray(encode([(prefix if encoder else "") + (t or "") for t in batch.column(at).to_pylist()]), dtype=np.float32).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.where(norm > 0, x / np.maximum(norm, 1e-12), 0).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out_col])

    return texts.mapInArrow(fn, schema)


def hashing_encoder(dim: int):
    import re

    import xxhash

    word = re.compile(r"\w+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            words = word.findall(text.lower())
            for gram in (*words, *map(" ".join, zip(words, words[1:]))):
                h = xxhash.xxh3_64_intdigest(gram.encode())
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return encode
