"""Queries of the conversation engine's operators, each with the SQL that gives the same rows.

Searches ask every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import unicodedata
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import parsing as P
from chatloom.operators import limits, search, store
from chatloom.operators.ordered import carry_forward
from chatloom.operators.people import asked_speakers, known_names, people_counts
from chatloom.operators.windows import WindowRules, build_windows, labelled, window_members, window_spans
from chatloom.session import read_table

EVERY = 50
NOW = 1_693_000_000  # the "now" of questions: a fixed instant after the messages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_messages(read_table(spark, d, "messages"))


# the current rows: text of the last delivery, the rest of the first
CUR = """cur AS (
  SELECT chat_id, msg_id, f.reply_to AS reply_to, f.sender_id AS sender_id, f.sender AS sender, f.ts AS ts, text FROM (
    SELECT chat_id, msg_id, arg_min({'reply_to': reply_to, 'sender_id': sender_id, 'sender': sender, 'ts': ts}, id) AS f, arg_max(text, id) AS text
    FROM messages WHERE chat_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY 1, 2))"""

# ---------------------------------------------------------------- tables, upserts, dimensions


@query(f"WITH {CUR} SELECT chat_id, msg_id, reply_to, sender_id, sender, ts, text FROM cur")
def msg_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("chat_id", "msg_id", "reply_to", "sender_id", "sender", "ts", "text")


@query(
    f"""WITH {CUR}, m AS (SELECT CASE WHEN chat_id % 3 = 0 THEN chat_id - chat_id % 10 - 1 ELSE chat_id END AS new_chat, chat_id % 3 = 0 AS moved, * FROM cur)
    SELECT new_chat AS chat_id, msg_id, arg_min(ts, (moved, chat_id)) AS ts, arg_min(text, (moved, chat_id)) AS text FROM m GROUP BY 1, 2"""
)
def chat_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every third chat is moved onto another id; where two meet, the chat that was there, then the smaller id, wins."""
    m = _messages(spark, d)
    moves = F.col("chat_id") % 3 == 0
    moved = m.select(
        F.when(moves, F.col("chat_id") - F.col("chat_id") % 10 - 1).otherwise(F.col("chat_id")).alias("chat_id"), "msg_id",
        F.struct(moves.alias("m"), F.col("chat_id").alias("c")).alias("__moved"), "ts", "text",
    )
    return store.merge_mapped(moved).select("chat_id", "msg_id", "ts", "text")


@query(
    """SELECT (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM windows) AS windows, (SELECT count(*) FROM window_vecs) AS embedded,
    (SELECT count(DISTINCT chat_id) FROM messages) AS chats, (SELECT strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%d %H:%M UTC') FROM messages) AS first_message,
    (SELECT strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%d %H:%M UTC') FROM messages) AS last_message"""
)
def stats(spark: SparkSession, d: str) -> DataFrame:
    return store.table_stats(*[read_table(spark, d, t) for t in ("messages", "windows", "window_vecs")])


@query(
    """SELECT m.sender_id, count(*) AS messages, coalesce(any_value(p.display_name), max(m.sender)) AS name, coalesce(any_value(p.source), 'export-label') AS source
    FROM messages m LEFT JOIN people p USING (sender_id) WHERE m.sender_id IS NOT NULL GROUP BY m.sender_id"""
)
def sender_template(spark: SparkSession, d: str) -> DataFrame:
    return store.sender_template(read_table(spark, d, "messages"), read_table(spark, d, "people"))


@query(
    """WITH fresh AS (SELECT DISTINCT sender_id FROM messages WHERE sender_id IS NOT NULL AND sender_id NOT IN (SELECT sender_id FROM aliases))
    SELECT sender_id, ordinal FROM aliases UNION ALL
    SELECT sender_id, row_number() OVER (ORDER BY sender_id) + (SELECT coalesce(max(ordinal), 0) FROM aliases) FROM fresh"""
)
def alias_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return store.assign_aliases(read_table(spark, d, "messages"), read_table(spark, d, "aliases"))


@query(
    """WITH changes AS (
      SELECT sender_id, display_name, username, source, updated_at, updated_at AS seq FROM people
      UNION ALL SELECT sender_id, sender, NULL, 'live', ts, ts FROM messages WHERE sender IS NOT NULL)
    , best AS (SELECT sender_id, arg_max({'d': display_name, 'u': username, 's': source, 'a': updated_at},
        (CASE source WHEN 'manual' THEN 2 WHEN 'api' THEN 1 ELSE 0 END, seq, display_name)) AS m
      FROM changes WHERE sender_id IS NOT NULL AND coalesce(display_name, '') <> '' GROUP BY 1)
    SELECT sender_id, trim(m.d, ' ') AS display_name, m.s AS source, m.a AS updated_at FROM best"""
)
def trust_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names seen live with the messages, merged into the stored people by trust."""
    people = read_table(spark, d, "people").withColumn("seq", F.col("updated_at"))
    live = read_table(spark, d, "messages").where("sender is not null").select(
        "sender_id", F.col("sender").alias("display_name"), F.lit(None).cast("string").alias("username"), F.lit("live").alias("source"), F.col("ts").alias("updated_at"), F.col("ts").alias("seq")
    )
    return store.merge_people(people.select(live.columns).unionByName(live), "seq").select("sender_id", "display_name", "source", "updated_at")


_LABEL = """CASE WHEN p.display_name <> '' THEN p.display_name %s WHEN m.sender_id IS NULL THEN 'User unknown'
  WHEN a.ordinal IS NOT NULL THEN 'User ' || a.ordinal ELSE 'User #' || m.sender_id END"""


@query(
    f"""WITH {CUR} SELECT chat_id, msg_id, {_LABEL % ''} AS name_label, {_LABEL % "WHEN m.sender <> '' THEN m.sender"} AS export_label,
    CASE WHEN m.sender_id IS NULL THEN 'User unknown' WHEN a.ordinal IS NOT NULL THEN 'User ' || a.ordinal ELSE 'User #' || m.sender_id END AS id_label
    FROM cur m LEFT JOIN people p USING (sender_id) LEFT JOIN aliases a ON a.sender_id = m.sender_id"""
)
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    people, aliases = read_table(spark, d, "people"), read_table(spark, d, "aliases")
    known = people.select("sender_id", "display_name").join(aliases, "sender_id", "full")
    args = (F.col("sender_id"), F.col("display_name"), F.col("sender"), F.col("ordinal"))
    return m.join(known, "sender_id", "left").select("chat_id", "msg_id", *[P.speaker_label(*args, mode).alias(f"{mode}_label") for mode in ("name", "export", "id")])


@query(
    f"""WITH {CUR}, s AS (SELECT chat_id, max(last_msg) AS last_indexed_msg_id FROM windows GROUP BY 1)
    SELECT chat_id, count(*) FILTER (WHERE msg_id > coalesce(last_indexed_msg_id, 0)) AS pending FROM cur LEFT JOIN s USING (chat_id) GROUP BY 1"""
)
def pending_count(spark: SparkSession, d: str) -> DataFrame:
    """Messages per chat that came since it was last indexed; the marks are those of the windows."""
    from chatloom.operators.incremental import pending

    state = read_table(spark, d, "windows").groupBy("chat_id").agg(F.max("last_msg").alias("last_indexed_msg_id"))
    return pending(_messages(spark, d), state)


@query(
    f"""WITH {CUR}, latest AS (SELECT chat_id, max(ts) AS ts FROM cur GROUP BY 1)
    , tail AS (SELECT chat_id, arg_max(first_msg, (last_msg, id)) AS tail FROM windows GROUP BY 1)
    , lookback AS (SELECT w.chat_id, min(first_msg) AS lookback FROM windows w JOIN latest l USING (chat_id) WHERE w.ts_end >= l.ts - 14 * 86400 GROUP BY 1)
    SELECT l.chat_id, coalesce(tail, 0) AS tail, lookback, least(coalesce(tail, 0), coalesce(lookback, coalesce(tail, 0))) AS boundary
    FROM latest l LEFT JOIN tail USING (chat_id) LEFT JOIN lookback USING (chat_id)"""
)
def rebuild_boundaries(spark: SparkSession, d: str) -> DataFrame:
    from chatloom.operators.incremental import boundaries

    return boundaries(_messages(spark, d), read_table(spark, d, "windows"), 14).select("chat_id", "tail", "lookback", "boundary")


@query("SELECT id, chat_id FROM windows WHERE id NOT IN (SELECT window_id FROM window_vecs WHERE window_id IS NOT NULL)")
def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    return store.pending_vectors(read_table(spark, d, "windows"), read_table(spark, d, "window_vecs")).select("id", "chat_id")


@query("SELECT window_id, len(vec) AS size FROM window_vecs WHERE window_id IN (SELECT id FROM windows)")
def cascade_vectors(spark: SparkSession, d: str) -> DataFrame:
    return store.without_orphans(read_table(spark, d, "window_vecs"), read_table(spark, d, "windows")).select("window_id", F.when(F.col("vec").isNotNull(), F.size("vec")).cast("bigint").alias("size"))


# ---------------------------------------------------------------- windows

_FOLD = f"""WITH RECURSIVE {CUR}, m AS (
  SELECT *, row_number() OVER w AS rn, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY chat_id ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    ts - lag(ts) OVER w AS gap FROM cur WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY chat_id ORDER BY ts, msg_id)
), r AS (SELECT a.*, b.rn AS reply_rn FROM m a LEFT JOIN m b ON b.chat_id = a.chat_id AND b.msg_id = a.reply_to)
, f AS (
  SELECT chat_id, rn, 1::BIGINT AS k, 0::BIGINT AS closed FROM r WHERE rn = 1
  UNION ALL
  SELECT r.chat_id, r.rn,
    CASE WHEN r.gap > 1800 AND NOT coalesce(r.reply_rn BETWEEN r.rn - f.k AND r.rn - 1, false) THEN 1
      WHEN f.k >= 25 OR r.before - s.before >= 1500 THEN least(f.k, 2) + 1 ELSE f.k + 1 END,
    CASE WHEN (r.gap > 1800 AND NOT coalesce(r.reply_rn BETWEEN r.rn - f.k AND r.rn - 1, false)) OR f.k >= 25 OR r.before - s.before >= 1500 THEN f.k ELSE 0 END
  FROM f JOIN r ON r.chat_id = f.chat_id AND r.rn = f.rn + 1 JOIN r s ON s.chat_id = f.chat_id AND s.rn = r.rn - f.k
), spans AS (
  SELECT chat_id, rn - closed AS a, rn - 1 AS b FROM f WHERE closed > 0
  UNION ALL SELECT chat_id, rn - k + 1, rn FROM f WHERE (chat_id, rn) IN (SELECT (chat_id, max(rn)) FROM m GROUP BY chat_id)
)"""


@query(
    f"""{_FOLD} SELECT s.chat_id, x.msg_id AS first_msg, y.msg_id AS last_msg, x.ts AS ts_start, y.ts AS ts_end, b - a + 1 AS n_msgs
    FROM spans s JOIN m x ON x.chat_id = s.chat_id AND x.rn = a JOIN m y ON y.chat_id = s.chat_id AND y.rn = b"""
)
def windows_full(spark: SparkSession, d: str) -> DataFrame:
    return window_spans(window_members(_messages(spark, d), WindowRules()))


@query(f"{_FOLD} SELECT s.chat_id, y.msg_id AS last_msg, x.msg_id, CAST(x.rn - a AS INTEGER) AS pos FROM spans s JOIN m x ON x.chat_id = s.chat_id AND x.rn BETWEEN a AND b JOIN m y ON y.chat_id = s.chat_id AND y.rn = b")
def window_membership(spark: SparkSession, d: str) -> DataFrame:
    return window_members(_messages(spark, d)).select("chat_id", F.col("window_end_msg").alias("last_msg"), "msg_id", "pos")


@query(
    f"""{_FOLD}, l AS (SELECT m.*, {_LABEL % ''} AS label FROM m LEFT JOIN people p USING (sender_id) LEFT JOIN aliases a ON a.sender_id = m.sender_id)
    SELECT s.chat_id, arg_min(x.msg_id, x.rn) AS first_msg, arg_max(x.msg_id, x.rn) AS last_msg, min(x.ts) AS ts_start, max(x.ts) AS ts_end,
      array_to_string(list_sort(list_distinct(list(x.label))), ', ') AS speakers,
      string_agg('[' || strftime(make_timestamp(x.ts * 1000000), '%Y-%m-%d %H:%M') || '] ' || label || ': ' || coalesce(x.text, ''), chr(10) ORDER BY x.rn) AS text
    FROM spans s JOIN l x ON x.chat_id = s.chat_id AND x.rn BETWEEN a AND b GROUP BY s.chat_id, s.a, s.b"""
)
def window_render(spark: SparkSession, d: str) -> DataFrame:
    return build_windows(_messages(spark, d), read_table(spark, d, "people"), read_table(spark, d, "aliases"))


@query(
    """WITH d AS (SELECT msg_id, chat_id, arg_max(text, id) AS text FROM messages GROUP BY ALL)
    SELECT w.id AS window_id, d.chat_id, d.msg_id FROM windows w JOIN d ON d.chat_id = w.chat_id AND d.msg_id BETWEEN w.first_msg AND w.last_msg"""
)
def window_containment(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the stored windows whose range of ids holds them, by buckets of ids."""
    m = _messages(spark, d).select("chat_id", "msg_id")
    w = read_table(spark, d, "windows").select(F.col("id").alias("window_id"), "chat_id", "first_msg", "last_msg")
    return search.interval_join(m, w, "chat_id", "msg_id", "first_msg", "last_msg").select("window_id", "chat_id", "msg_id")


# ---------------------------------------------------------------- full text

# letters of which Unicode says that they are an English letter and one mark, and the marks that the index drops
_ONE_MARK = {
    chr(c).lower(): chr(int(d[0], 16)).lower()
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<" and int(d[0], 16) < 128 and len(chr(c).lower()) == 1
}
_MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
_FOLDED = f"translate(lower(%s), '{''.join(_ONE_MARK)}\u017f\u1e9b{_MARKS}', '{''.join(_ONE_MARK.values())}ss')"
_DOCS = f"""docs AS (SELECT chat_id, msg_id, regexp_extract_all({_FOLDED % 'text'}, '[\\p{{L}}\\p{{N}}]+') AS terms FROM cur)
, toks AS (SELECT chat_id, msg_id, len(terms) AS dl, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM docs)
, tf AS (SELECT term, chat_id, msg_id, dl, count(*) AS f FROM toks GROUP BY ALL)
, size AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs)"""
_PHRASES = f"""q AS (SELECT qid, unnest(list_filter(regexp_extract_all({_FOLDED % 'question'}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1)) AS token FROM questions)
, qt AS (SELECT qid, token, count(*) AS times, list_filter(string_split(token, '_'), lambda t: t <> '') AS phrase FROM q GROUP BY ALL)
, phr AS (SELECT * FROM qt WHERE len(phrase) > 0)
, dis AS (SELECT DISTINCT token, phrase FROM phr)
, part AS (SELECT token, len(phrase) AS size, unnest(phrase) AS term, generate_subscripts(phrase, 1) AS off FROM dis WHERE len(phrase) > 1)
, beg AS (SELECT token, size, chat_id, msg_id, dl, pos - off AS b, count(DISTINCT off) AS met FROM part JOIN toks USING (term) GROUP BY ALL)
, hit AS (SELECT token, chat_id, msg_id, f, dl FROM dis JOIN tf ON tf.term = dis.phrase[1] WHERE len(phrase) = 1
  UNION ALL SELECT token, chat_id, msg_id, count(*), dl FROM beg WHERE met = size GROUP BY token, chat_id, msg_id, dl)
, df AS (SELECT token, count(*) AS df FROM hit GROUP BY 1)
, cnt AS (SELECT phr.*, coalesce(df, 0) AS df, n, avgdl, coalesce(df, 0) <= 0.25 * n AS keep FROM phr LEFT JOIN df USING (token) CROSS JOIN size)
, inf AS (SELECT * FROM (SELECT *, bool_or(keep) OVER (PARTITION BY qid) AS anyk FROM cnt) WHERE keep OR NOT anyk)"""
_BM25 = """, scored AS (SELECT qid, chat_id, msg_id, sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM inf JOIN hit USING (token) GROUP BY ALL)"""
_MSG_QUESTIONS = f"questions AS (SELECT id AS qid, text AS question, chat_id FROM messages WHERE id % {EVERY} = 0)"


def message_questions(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "messages").where(F.col("id") % EVERY == 0)
    return m.select(F.col("id").alias("qid"), F.col("text").alias("question"), F.array("chat_id").alias("chats"))


@query(f"WITH {CUR}, {_DOCS} SELECT term, count(*) AS df, CAST(sum(f) AS BIGINT) AS occurrences FROM tf GROUP BY 1")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    index = search.postings(_messages(spark, d))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {CUR}, {_DOCS}, {_MSG_QUESTIONS}, {_PHRASES} SELECT qid, token, times, df FROM inf")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    phrases = search.question_phrases(message_questions(spark, d))
    matches = search.phrase_matches(phrases, search.postings(m))
    return search.informative(phrases, matches, search.corpus_size(m)).select("qid", "token", "times", "df")


@query(
    f"""WITH {CUR}, {_DOCS}, {_MSG_QUESTIONS}, {_PHRASES} {_BM25}
    SELECT qid, chat_id, msg_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chat_id, msg_id) AS rank FROM scored) WHERE rank <= 10"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_top(message_questions(spark, d), _messages(spark, d), 10, digits=6).select("qid", "chat_id", "msg_id", "score", "rank")


@query(
    f"""WITH {CUR}, {_DOCS}, {_MSG_QUESTIONS}, {_PHRASES} {_BM25}
    SELECT qid, chat_id, msg_id, round(score, 6) AS score, rank FROM (
      SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, s.chat_id, msg_id) AS rank FROM scored s JOIN questions o USING (qid) WHERE o.chat_id = s.chat_id) WHERE rank <= 10"""
)
def chat_scope(spark: SparkSession, d: str) -> DataFrame:
    """Each question sees its own chat only, with the statistics of all."""
    return search.bm25_top(message_questions(spark, d), _messages(spark, d), 10, chats="chats", digits=6).select("qid", "chat_id", "msg_id", "score", "rank")


# ---------------------------------------------------------------- vectors and fusion

_VECS = """vecs AS (SELECT window_id, min(vec) AS vec FROM window_vecs WHERE window_id IS NOT NULL AND len(vec) = 64
  AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY 1)
, places AS (SELECT v.window_id, v.vec, chat_id, ts_start, ts_end FROM vecs v JOIN windows w ON w.id = v.window_id)"""
_WIN_QUESTIONS = f"""questions AS (SELECT w.id AS qid, regexp_replace(string_split(w.text, chr(10))[-1], '^\\[[^\\]]*\\] [^:]*: ', '') AS question, v.vec AS vec,
  w.chat_id AS q_chat, w.ts_start - 86400 AS q_start, w.ts_end + 86400 AS q_end, string_split(w.speakers, ', ')[1] AS q_speaker
  FROM windows w LEFT JOIN vecs v ON v.window_id = w.id WHERE w.id % {EVERY} = 0)"""


def window_questions(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """What the last line of a window says, with the window's vector, for every window divisible by 50."""
    w = read_table(spark, d, "windows").where(F.col("id") % EVERY == 0)
    v = search.usable_vectors(read_table(spark, d, "window_vecs"), 64)
    line = F.regexp_replace(F.element_at(F.split("text", "\n"), -1), "^\\[[^\\]]*\\] [^:]*: ", "")
    more = {
        "chats": F.array("chat_id").alias("chats"), "start": (F.col("ts_start") - 86400).alias("start"), "end": (F.col("ts_end") + 86400).alias("end"),
        "speaker": F.split("speakers", ", ")[0].alias("speaker"),
    }
    return w.join(v, w["id"] == v["window_id"], "left").select(F.col("id").alias("qid"), line.alias("question"), "vec", *[more[e] for e in extra])


def _places(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "windows").select(F.col("id").alias("window_id"), "chat_id", "ts_start", "ts_end")
    return search.usable_vectors(read_table(spark, d, "window_vecs"), 64).join(w, "window_id")


_KNN = """near AS (SELECT qid, window_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, window_id) AS rank FROM (
  SELECT qid, window_id, round(list_cosine_similarity(q.vec::DOUBLE[], p.vec::DOUBLE[]), 6) AS score FROM questions q CROSS JOIN places p WHERE q.vec IS NOT NULL %s))"""


@query(f"WITH {_VECS}, {_WIN_QUESTIONS}, {_KNN % ''} SELECT qid, window_id, score, rank FROM near WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = window_questions(spark, d).where("vec is not null")
    return search.knn(asked, _places(spark, d), 10).select("qid", "window_id", "score", "rank")


@query(f"WITH {_VECS}, {_WIN_QUESTIONS}, {_KNN % 'AND p.ts_end >= q_start AND p.ts_start <= q_end AND p.chat_id = q_chat'} SELECT qid, window_id, score, rank FROM near WHERE rank <= 10")
def time_filter(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors within a day of the question's window, in its chat."""
    asked = window_questions(spark, d, "chats", "start", "end").where("vec is not null")
    return search.knn(asked, _places(spark, d), 10, extra=["chats", "start", "end"]).select("qid", "window_id", "score", "rank")


def _keyword(pool: int, where: str = "", time: str = "") -> str:
    return f""", cut AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, s.chat_id, msg_id) AS rank FROM scored s {where}) WHERE rank <= {pool * 20})
    , kw AS (SELECT * FROM (SELECT qid, window_id, row_number() OVER (PARTITION BY qid ORDER BY best, window_id) AS kw_rank FROM (
      SELECT cut.qid, w.id AS window_id, min(rank) AS best FROM cut JOIN windows w ON w.chat_id = cut.chat_id AND cut.msg_id BETWEEN w.first_msg AND w.last_msg {time} GROUP BY ALL)) WHERE kw_rank <= {pool})"""


def _fused(pool: int) -> str:
    return f""", vr AS (SELECT qid, window_id, rank AS vec_rank FROM near WHERE rank <= {pool})
    , fused AS (SELECT qid, window_id, kw_rank, vec_rank, round(coalesce(0.7 / (20 + kw_rank), 0) + coalesce(1.0 / (20 + vec_rank), 0), 12) AS score FROM kw FULL JOIN vr USING (qid, window_id))
    , best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kw_rank NULLS LAST, vec_rank NULLS LAST, window_id) AS rank FROM fused)"""


@query(f"WITH {CUR}, {_DOCS}, {_VECS}, {_WIN_QUESTIONS}, {_PHRASES} {_BM25} {_keyword(40)} SELECT qid, window_id, kw_rank AS rank FROM kw")
def keyword_windows(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_arm(window_questions(spark, d).drop("vec"), _messages(spark, d), read_table(spark, d, "windows"), 40)


@query(f"WITH {CUR}, {_DOCS}, {_VECS}, {_WIN_QUESTIONS}, {_KNN % ''}, {_PHRASES} {_BM25} {_keyword(40)} {_fused(40)} SELECT qid, window_id, kw_rank, vec_rank, round(score, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    q = window_questions(spark, d)
    keyword = search.keyword_arm(q.drop("vec"), _messages(spark, d), read_table(spark, d, "windows"), 40)
    near = search.knn(q.where("vec is not null"), _places(spark, d), 40)
    return search.fuse(keyword, near).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {CUR}, {_DOCS}, {_VECS}, {_WIN_QUESTIONS}, {_KNN % ''}, {_PHRASES} {_BM25} {_keyword(40)} {_fused(40)}
    SELECT qid, rank, window_id, round(b.score, 9) AS score, chat_id, first_msg, last_msg, ts_start, ts_end, speakers, text FROM best b JOIN windows w ON w.id = window_id WHERE rank <= 10"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid_search(window_questions(spark, d), _messages(spark, d), read_table(spark, d, "windows"), search.usable_vectors(read_table(spark, d, "window_vecs"), 64))
    return hits.withColumn("score", F.round("score", 9))


@query(
    f"""WITH {CUR}, {_DOCS}, {_VECS}, {_WIN_QUESTIONS}, {_KNN % 'AND p.ts_end >= q_start AND p.ts_start <= q_end AND p.chat_id = q_chat'}, {_PHRASES} {_BM25}
    {_keyword(80, 'JOIN questions o USING (qid) WHERE o.q_chat = s.chat_id', 'JOIN questions o ON o.qid = cut.qid WHERE w.ts_end >= q_start AND w.ts_start <= q_end')} {_fused(80)}
    SELECT b.qid, rank, window_id, round(b.score, 9) AS score FROM best b JOIN windows w ON w.id = window_id JOIN questions o USING (qid)
    WHERE rank <= 10 AND (q_speaker IS NULL OR contains(lower(coalesce(w.speakers, '')), lower(q_speaker)))"""
)
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Search with an allow-list of chats, a time range and a speaker; the speaker is looked for after the cut."""
    q = window_questions(spark, d, "chats", "start", "end", "speaker")
    hits = search.hybrid_search(q, _messages(spark, d), read_table(spark, d, "windows"), search.usable_vectors(read_table(spark, d, "window_vecs"), 64))
    return hits.select("qid", "rank", "window_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {CUR}, {_DOCS}, {_VECS}, {_WIN_QUESTIONS}, {_KNN % ''}, {_PHRASES} {_BM25} {_keyword(40)} {_fused(40)}
    , blob AS (SELECT qid, lower(string_agg(text, chr(10))) AS blob FROM best JOIN windows w ON w.id = window_id WHERE rank <= 10 GROUP BY 1)
    SELECT qid, coalesce(contains(blob, lower(question)), false) AS hit FROM questions LEFT JOIN blob USING (qid)"""
)
def success_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Whether the searched sentence itself is in one of the ten hits."""
    q = window_questions(spark, d)
    hits = search.hybrid_search(q, _messages(spark, d), read_table(spark, d, "windows"), search.usable_vectors(read_table(spark, d, "window_vecs"), 64))
    return search.success_at_k(hits, q.select("qid", F.array("question").alias("needles")))


@query(f"SELECT w.id AS window_id, n.display_name FROM windows w JOIN (SELECT DISTINCT display_name FROM people) n ON contains(lower(coalesce(w.speakers, '')), lower(n.display_name))")
def speaker_filter(spark: SparkSession, d: str) -> DataFrame:
    """Windows by the names of people that their speakers hold, in any case.

    A name can only be found where its first three letters begin a stretch of the
    speakers, so both sides meet on those three letters, or on all that a shorter name has.
    """
    w = read_table(spark, d, "windows").select(F.col("id").alias("window_id"), F.lower(F.coalesce("speakers", F.lit(""))).alias("low"))
    names = read_table(spark, d, "people").select("display_name").distinct().withColumn("key", F.substring(F.lower("display_name"), 1, 3))
    starts = F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1)))
    of_size = lambda n: F.transform(starts, lambda i: F.substring(F.col("low"), i, F.lit(n)))
    grams = w.withColumn("key", F.explode(F.array_distinct(F.concat(*[of_size(n) for n in (0, 1, 2, 3)]))))
    return grams.join(names, "key").where(F.contains(F.col("low"), F.lower("display_name"))).select("window_id", "display_name")


# ---------------------------------------------------------------- scalar functions

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"regexp_replace(%s, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_OPENING = (
    r"(?is)^(what about(\s+\w+){0,3}\??$|(and|also)\s+(what|how|who|when|why|the)\b|how much (was|is|were|are) (it|that|those|them)\b|"
    r"(who|what|when|where|why|how) (was|is|were|are) (it|that|this)\b|the other one\b|(and|also|wait)[,!]?\s+)"
)


@query(
    f"""WITH {CUR}, p AS (SELECT chat_id, msg_id, text, {_STRIP % 'text'} AS q, {_STRIP % "coalesce(lag(text) OVER (PARTITION BY chat_id, sender_id ORDER BY ts, msg_id), '')"} AS prior FROM cur)
    , f AS (SELECT *, q <> '' AND (regexp_matches(q, '{_OPENING}') OR (len(regexp_split_to_array(q, '{_BLANK}+')) <= 5 AND regexp_matches(q, '(?i)\\b(it|that|those|them|this|one)\\b'))) AS follow_up FROM p)
    SELECT chat_id, msg_id, follow_up, CASE WHEN prior <> '' AND follow_up THEN prior || ' — follow-up: ' || q ELSE q END AS standalone FROM f"""
)
def followup_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Each message as a question after the one before it of the same sender in the chat."""
    m = _messages(spark, d)
    return carry_forward(m, ["chat_id", "sender_id"], ["ts", "msg_id"], {"text": "prior"}).select("chat_id", "msg_id", P.is_follow_up(F.col("text")).alias("follow_up"), P.standalone(F.col("text"), F.col("prior")).alias("standalone"))


_MONTH_WORD = "(september|february|november|december|january|october|august|march|april|sept|june|july|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def _time_ranges() -> str:
    """The time phrases in SQL; what they mean at ``NOW`` is worked out here with Python's calendar."""
    now = datetime.fromtimestamp(NOW, timezone.utc)
    day = now.replace(hour=0, minute=0, second=0)
    at = lambda t: int(t.timestamp())
    month, year = day.replace(day=1), day.replace(month=1, day=1)
    before = (month - timedelta(days=1)).replace(day=1)
    fixed = [
        ("last night", "last night", at(day) - 7 * 3600, at(day) + 8 * 3600), ("yesterday", "yesterday", at(day) - 86400, at(day) - 1), ("today", "today", at(day), at(day) + 86399),
        ("this week", "this week", at(day - timedelta(days=day.weekday())), NOW), ("(last|past) week", "last week", NOW - 7 * 86400, NOW), ("this month", "this month", at(month), NOW),
        ("last month", "last month", at(before), at(month) - 1), ("this year", "this year", at(year), NOW), ("last year", "last year", at(year.replace(year=year.year - 1)), at(year) - 1),
    ]
    cases = lambda value: " ".join(f"WHEN regexp_matches(q, '\\b{p}\\b') THEN {value(label, a, b)}" for p, label, a, b in fixed)
    named = lambda c: f"""CASE WHEN {c}_m <> '' THEN make_date(coalesce(TRY_CAST({c}_y AS INTEGER), CASE WHEN {c}_n <= {now.month} THEN {now.year} ELSE {now.year - 1} END), {c}_n, 1) END AS {c}_d"""
    words = lambda c, lead: ", ".join(f"regexp_extract(q, '\\b{lead} {_MONTH_WORD}(?:\\s+(\\d{{4}}))?\\b', {g}) AS {c}_{k}" for g, k in ((1, "m"), (2, "y")))
    number = lambda c: f"CASE WHEN {c}_m <> '' THEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr({c}_m, 1, 3)) END AS {c}_n"
    return f"""WITH t AS (SELECT 'messages' AS tab, id AS row_id, lower(text) AS q FROM messages UNION ALL SELECT 'documents', doc_id, lower(text) FROM documents)
    , w AS (SELECT *, regexp_extract(q, '\\b(20\\d{{2}}-\\d{{2}}-\\d{{2}})\\b', 1) AS iso, {words('i', 'in')}, {words('s', 'since')} FROM t)
    , n AS (SELECT *, {number('i')}, {number('s')} FROM w)
    , d AS (SELECT *, TRY_CAST(iso AS DATE) AS iso_d, {named('i')}, {named('s')} FROM n)
    , r AS (SELECT tab, row_id,
        CASE WHEN iso <> '' THEN epoch(iso_d) WHEN i_m <> '' THEN epoch(i_d) WHEN s_m <> '' THEN epoch(s_d) {cases(lambda _, a, b: a)} END AS range_start,
        CASE WHEN iso <> '' THEN epoch(iso_d) + 86399 WHEN i_m <> '' THEN epoch(i_d + INTERVAL 1 MONTH) - 1 WHEN s_m <> '' THEN {NOW} {cases(lambda _, a, b: b)} END AS range_end,
        CASE WHEN iso <> '' THEN iso WHEN i_m <> '' THEN monthname(i_d) || ' ' || year(i_d) WHEN s_m <> '' THEN 'since ' || monthname(s_d) || ' ' || year(s_d) {cases(lambda label, a, b: f"'{label}'")} END AS label FROM d)
    SELECT tab, row_id, CAST(range_start AS BIGINT) AS range_start, CAST(range_end AS BIGINT) AS range_end, label FROM r WHERE range_start IS NOT NULL"""


@query(_time_ranges())
def time_range_parse(spark: SparkSession, d: str) -> DataFrame:
    """The time phrases of messages and documents, seen from a fixed now."""
    m = read_table(spark, d, "messages").select(F.lit("messages").alias("tab"), F.col("id").alias("row_id"), "text")
    x = read_table(spark, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), "text")
    r = m.unionByName(x).withColumn("r", P.time_range(F.col("text"), F.lit(NOW).cast("bigint"))).where("r is not null")
    return r.select("tab", "row_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"), F.col("r.label").alias("label"))


@query(
    r"""WITH n AS (SELECT DISTINCT display_name, regexp_escape(lower(display_name)) AS e FROM people WHERE length(display_name) >= 3)
    , c AS MATERIALIZED (SELECT id, text, lower(text) AS low FROM messages WHERE regexp_matches(text, '(?i)\b(did|said|says|told|tell|from|by|according to)\b'))
    , j AS MATERIALIZED (SELECT c.id, low, e, display_name FROM c JOIN n ON contains(low, lower(display_name)))
    SELECT id, arg_min(display_name, (-length(display_name), lower(display_name), display_name)) AS speaker FROM j
    WHERE regexp_matches(low, '(^|[^\p{L}\p{N}_])(?:what |who )?did ' || e || ' (?:say|tell|ask)\b|(^|[^\p{L}\p{N}_])' || e || ' (?:said|says|told|wrote)\b|\b(?:from|by|according to) ' || e || '([^\p{L}\p{N}_]|$)')
    GROUP BY id"""
)
def speaker_parse(spark: SparkSession, d: str) -> DataFrame:
    """Whom a message asks about: the longest known name in one of the turns of phrase."""
    return asked_speakers(read_table(spark, d, "messages").select("id", "text"), known_names(read_table(spark, d, "people")))


@query(
    r"""WITH n AS (SELECT doc_id, text, 5 AS n FROM documents WHERE regexp_matches(text, '\[W\d+\]'))
    SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[W(\d+)\]', 1), lambda x: try_cast(x AS INTEGER)), lambda i: i BETWEEN 1 AND 5))) AS cited FROM n"""
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    """The tags of answers, as if each had five hits."""
    docs = read_table(spark, d, "documents").where(F.col("text").rlike("\\[W\\d+\\]"))
    return docs.select("doc_id", P.cited(F.col("text"), F.lit(5)).alias("cited"))


@query(
    r"""WITH c AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[W(\d+)\]', 1), lambda x: try_cast(x AS INTEGER)), lambda i: i BETWEEN 1 AND 5))) AS c
      FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN len(c) > 0 THEN c[1:3] ELSE [1, 2, 3] END AS sources, CASE WHEN len(c) > 0 THEN c[1] ELSE 1 END AS first_source FROM c"""
)
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    """Up to three sources of each answer: the cited ones, else the top hits."""
    docs = read_table(spark, d, "documents").where("text is not null")
    numbers = P.source_numbers(P.cited(F.col("text"), F.lit(5)), F.lit(5))
    return docs.select("doc_id", numbers.alias("sources"), F.try_element_at(numbers, F.lit(1)).alias("first_source"))


@query(
    r"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts_start DESC, id DESC) AS r FROM windows)
    , h AS (SELECT chat_id, string_agg('[W' || r || '] ' || strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') || ', ' || coalesce(speakers, '') || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS context,
      string_agg('[W' || r || ']' || CASE WHEN r = 2 THEN ' ✓' ELSE '' END || ' ' || strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') || ' · ' || coalesce(speakers, '') || ' · https://t.me/c/' || regexp_replace(chat_id::VARCHAR, '^(-100|-+)', '') || '/' || first_msg, chr(10) ORDER BY r) AS sources
      FROM w WHERE r <= 3 GROUP BY 1) SELECT chat_id, context, sources FROM h"""
)
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The three latest windows of each chat as excerpts for a prompt, and as a list of sources with the second one cited."""
    w = read_table(spark, d, "windows").withColumn("speakers", F.coalesce("speakers", F.lit("")))
    last = search.top(w, "chat_id", [F.desc("ts_start"), F.desc("id")], 3)
    hits = last.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ts_start", "speakers", "text", "chat_id", "first_msg"))).alias("hits"))
    return hits.select("chat_id", P.context_block(F.col("hits")).alias("context"), P.sources_block(F.col("hits"), F.array(F.lit(2))).alias("sources"))


@query(
    """SELECT DISTINCT chat_id, 'https://t.me/c/' || regexp_replace(chat_id::VARCHAR, '^(-100|-+)', '') || '/1' AS link,
    CASE WHEN chat_id::VARCHAR LIKE '-100_%' THEN [substr(chat_id::VARCHAR, 5)::BIGINT] WHEN chat_id < 0 THEN [-chat_id] ELSE [] END AS export_ids,
    CASE WHEN chat_id < 0 THEN chat_id ELSE ('-100' || chat_id)::BIGINT END AS live_id FROM messages WHERE chat_id IS NOT NULL"""
)
def chat_id_map(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "messages").where("chat_id is not null").select("chat_id").distinct()
    chat = F.col("chat_id")
    return c.select("chat_id", P.chat_link(chat, F.lit(1)).alias("link"), P.export_chat_ids(chat).alias("export_ids"), P.live_chat_id(chat, F.lit("private_supergroup")).alias("live_id"))


@query(
    """WITH t AS (SELECT doc_id, greatest(1, (strlen(text) + 1) // 2) AS tokens FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, tokens, CASE WHEN 2000 - tokens - 24 >= 256 THEN least(2048, 2000 - tokens - 24) END AS completion FROM t"""
)
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", P.estimated_tokens(F.col("text")).alias("tokens"))
    return docs.withColumn("completion", P.completion_tokens(F.col("tokens") + 24, F.lit(4096), F.lit(2000)).cast("bigint"))


@query(r"SELECT id, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS short, contains(lower(text), '@ilse_63') AS mentioned FROM messages")
def message_display(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "messages")
    return m.select("id", P.shortened(F.col("text"), 120).alias("short"), P.mentions(F.col("text"), F.lit("Ilse_63")).alias("mentioned"))


@query("SELECT id, strftime(make_timestamp((ts + 2 * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC+02:00' AS shown, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M UTC') AS utc FROM messages")
def display_times(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "messages").select("id", P.display_time(F.col("ts"), F.lit(2)).alias("shown"), P.utc_label(F.col("ts")).alias("utc"))


# ---------------------------------------------------------------- stateful folds

_EVENTS = "ev AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS rn FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return read_table(spark, d, "events").select("event_id", "user_id", t.cast("bigint").alias("t"))


@query(
    f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT event_id, user_id, rn, t, t AS last, true AS accepted FROM ev WHERE rn = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.rn, e.t, CASE WHEN e.t - f.last >= 14400 THEN e.t ELSE f.last END, e.t - f.last >= 14400 FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, user_id, accepted FROM f"""
)
def cooldown_accept(spark: SparkSession, d: str) -> DataFrame:
    return limits.cooldown(_events(spark, d), "user_id", "t", "event_id", 14_400).select("event_id", "user_id", "accepted")


@query(
    f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT event_id, user_id, rn, [t] AS hits, true AS accepted FROM ev WHERE rn = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.rn, CASE WHEN len(list_filter(f.hits, lambda h: h > e.t - 86400)) < 3 THEN list_append(list_filter(f.hits, lambda h: h > e.t - 86400), e.t)
      ELSE list_filter(f.hits, lambda h: h > e.t - 86400) END, len(list_filter(f.hits, lambda h: h > e.t - 86400)) < 3 FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, user_id, accepted FROM f"""
)
def quota_accept(spark: SparkSession, d: str) -> DataFrame:
    return limits.quota(_events(spark, d), "user_id", "t", "event_id", 3, 86_400).select("event_id", "user_id", "accepted")


@query(
    f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT event_id, user_id, rn, t, t AS last, 0::BIGINT AS held, true AS sent, 0::BIGINT AS suppressed FROM ev WHERE rn = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.rn, e.t, CASE WHEN e.t - f.last < 7200 THEN f.last ELSE e.t END, CASE WHEN e.t - f.last < 7200 THEN f.held + 1 ELSE 0 END,
      e.t - f.last >= 7200, CASE WHEN e.t - f.last < 7200 THEN 0 ELSE f.held END FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT event_id, user_id, sent, suppressed FROM f"""
)
def burst_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return limits.coalesce_bursts(_events(spark, d), "user_id", "t", "event_id", 7_200).select("event_id", "user_id", "sent", "suppressed")


@query(
    """WITH a AS (SELECT event_id AS id, user_id, epoch(ts)::BIGINT AS ts FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, epoch(ts)::BIGINT AS ts, max(event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT a.id, a.user_id, CASE WHEN a.ts - b.ts < 43200 THEN b.value END AS value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def ttl_asof(spark: SparkSession, d: str) -> DataFrame:
    """The user's last purchase, unless twelve hours old."""
    e = read_table(spark, d, "events").select("event_id", "event_type").join(_events(spark, d), "event_id").withColumnRenamed("t", "ts")
    facts = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("value"))
    asks = e.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("id"))
    return limits.ttl_lookup(asks, facts, ["user_id"], 43_200).select("id", "user_id", "value")


@query(
    """WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS t, row_number() OVER (ORDER BY epoch(ts)::BIGINT, event_id) AS rn FROM events)
    , f AS (SELECT event_id, user_id, rn, [{'t': t, 'u': user_id}] AS hits, NULL::VARCHAR AS blocked_by FROM ev WHERE rn = 1 UNION ALL
    SELECT event_id, user_id, rn, CASE WHEN blocked IS NULL THEN list_append(past, {'t': t, 'u': user_id}) ELSE past END, blocked FROM (
      SELECT *, CASE WHEN len(list_filter(past, lambda h: h.u = user_id)) >= 3 THEN 'user' WHEN len(past) >= 40 THEN 'global' END AS blocked FROM (
        SELECT e.event_id, e.user_id, e.rn, e.t, list_filter(f.hits, lambda h: h.t > e.t - 3600) AS past FROM f JOIN ev e ON e.rn = f.rn + 1)))
    SELECT event_id, user_id, blocked_by FROM f"""
)
def quota_two_levels(spark: SparkSession, d: str) -> DataFrame:
    return limits.two_level_quota(_events(spark, d), "user_id", "t", "event_id", 3, 40, 3_600.0).select("event_id", "user_id", "blocked_by")


@query(f"WITH {CUR} SELECT chat_id, msg_id, lag(text) OVER (PARTITION BY chat_id, sender_id ORDER BY ts, msg_id) AS prior FROM cur")
def prior_message(spark: SparkSession, d: str) -> DataFrame:
    return carry_forward(_messages(spark, d), ["chat_id", "sender_id"], ["ts", "msg_id"], {"text": "prior"}).select("chat_id", "msg_id", "prior")


# ---------------------------------------------------------------- sources


@query(
    f"""WITH {CUR}, s AS (SELECT *, {_STRIP % 'text'} AS t FROM cur)
    SELECT chat_id, msg_id, reply_to, sender_id, coalesce(nullif(sender, ''), 'Unknown') AS sender, ts, t AS text FROM s WHERE t <> '' AND ts IS NOT NULL"""
)
def export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All messages written as entries of a JSON export, texts of even ids in pieces, and read again."""
    from chatloom.sources.export import entries_to_messages, messages_to_entries

    entries = messages_to_entries(_messages(spark, d), pieces=F.col("msg_id") % 2 == 0)
    return entries_to_messages(entries).select("chat_id", "msg_id", "reply_to", "sender_id", "sender", "ts", "text")


@query(f"WITH {CUR}, {_DOCS} SELECT term, chat_id, msg_id, f AS tf, dl AS length FROM tf")
def postings_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The index of the first texts, brought up to date with the edited messages only."""
    rows = read_table(spark, d, "messages").dropna(subset=["chat_id", "msg_id"])
    first = rows.groupBy("chat_id", "msg_id").agg(F.min_by("text", "id").alias("text"))
    now = _messages(spark, d).select("chat_id", "msg_id", "text")
    changed = now.alias("n").join(first.alias("f"), ["chat_id", "msg_id"]).where(~F.col("n.text").eqNullSafe(F.col("f.text"))).select("chat_id", "msg_id", F.col("n.text").alias("text"))
    return search.refresh_postings(search.postings(first), changed).select("term", "chat_id", "msg_id", "tf", F.col("length").cast("bigint").alias("length"))


@query(
    """SELECT (SELECT count(*) FROM messages) || ' messages in ' || (SELECT count(DISTINCT chat_id) FROM messages) || ' chats, ' || (SELECT count(*) FROM windows) || ' windows, ' || (SELECT count(*) FROM window_vecs)
    || ' embedded; ' || (SELECT strftime(make_timestamp(min(ts) * 1000000), '%Y-%m-%d %H:%M UTC') || ' to ' || strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%d %H:%M UTC') FROM messages) AS line"""
)
def stats_line(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).select(P.stats_text(*[F.col(c) for c in ("messages", "windows", "embedded", "chats", "first_message", "last_message")]).alias("line"))


@query(
    f"""WITH {CUR}, {_DOCS}, {_VECS}, {_WIN_QUESTIONS}, {_KNN % ''}, {_PHRASES} {_BM25} {_keyword(40)} {_fused(40)}
    , h AS (SELECT b.qid, b.rank, w.* FROM best b JOIN windows w ON w.id = b.window_id WHERE rank <= 10)
    , l AS (SELECT qid, count(*) AS n, list(id ORDER BY rank) AS ids, max(CASE WHEN rank = 2 THEN strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') || ', ' || speakers || ':' END) AS second,
        string_agg('[W' || rank || ']' || CASE WHEN rank = 2 THEN ' ✓' ELSE '' END || ' ' || strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') || ' · ' || speakers || ' · https://t.me/c/' || regexp_replace(chat_id::VARCHAR, '^(-100|-+)', '') || '/' || first_msg, chr(10) ORDER BY rank) AS sources,
        max(CASE WHEN rank = 2 THEN '<a href="https://t.me/c/' || regexp_replace(chat_id::VARCHAR, '^(-100|-+)', '') || '/' || first_msg || '">[W2]</a>' END) AS link FROM h GROUP BY qid)
    , a AS (SELECT q.qid, q.question, coalesce(n, 0) AS n, ids, sources, link, CASE WHEN n IS NULL THEN 'I couldn''t find that in the chat history.' ELSE coalesce(second, 'Excerpts:') || ' [W2] [W99]' END AS answer FROM questions q LEFT JOIN l USING (qid))
    SELECT qid, question, answer, coalesce(ids, []) AS window_ids, CASE WHEN n >= 2 THEN [ids[2]] ELSE [] END AS cited_ids, CASE WHEN n >= 2 THEN [2] WHEN n = 1 THEN [1] ELSE [] END AS source_numbers,
      coalesce(sources, '') AS sources, replace(replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[W2]', coalesce(link, '[W2]')) AS display, 'stand-in' AS model FROM a"""
)
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Each question answered by a stand-in for a model: the first line of the second excerpt, cited."""
    from chatloom.operators.answers import answer

    def stand_in():
        return lambda system, prompt: prompt.split("[W2] ")[-1].split("\n")[0] + " [W2] [W99]"

    q = window_questions(spark, d)
    hits = search.hybrid_search(q, _messages(spark, d), read_table(spark, d, "windows"), search.usable_vectors(read_table(spark, d, "window_vecs"), 64))
    return answer(q, hits, stand_in, "stand-in").drop("latency_ms")


_MOVED = "CASE WHEN chat_id % 3 = 0 THEN chat_id - chat_id % 10 - 1 ELSE chat_id END"


@query(
    f"""WITH {CUR}, m AS (SELECT {_MOVED} AS new_chat, chat_id % 3 = 0 AS moved, * FROM cur)
    , x AS (SELECT new_chat AS chat_id, msg_id, arg_min(text, (moved, reply_to, sender_id, sender, ts, text)) AS text FROM m GROUP BY 1, 2)
    , s AS (SELECT {_MOVED} AS chat_id, max(last_msg) AS mark FROM windows GROUP BY 1)
    SELECT 'message' AS kind, chat_id, msg_id AS id, text AS value FROM x
    UNION ALL SELECT 'window', {_MOVED}, id, text FROM windows
    UNION ALL SELECT 'mark', chat_id, mark, NULL FROM s"""
)
def chat_remap(spark: SparkSession, d: str) -> DataFrame:
    """Every third chat moves to another id, with its messages, windows and high-water mark."""
    from chatloom.streaming.live import PREFS_SCHEMA, remap_chats

    messages, windows = _messages(spark, d), read_table(spark, d, "windows")
    state = windows.groupBy("chat_id").agg(F.max("last_msg").alias("last_indexed_msg_id"))
    chats = messages.select("chat_id").unionByName(windows.select("chat_id")).distinct().where("chat_id % 3 = 0")
    moves = chats.select("chat_id", (F.col("chat_id") - F.col("chat_id") % 10 - 1).alias("live_id"))
    t = remap_chats(messages, windows, state, spark.createDataFrame([], PREFS_SCHEMA), moves)
    rows = [("message", "messages", "msg_id", F.col("text")), ("window", "windows", "id", F.col("text")), ("mark", "state", "last_indexed_msg_id", F.lit(None).cast("string"))]
    a, b, c = [t[name].select(F.lit(kind).alias("kind"), "chat_id", F.col(i).alias("id"), value.alias("value")) for kind, name, i, value in rows]
    return a.unionByName(b).unionByName(c)


@query(
    """SELECT (SELECT count(DISTINCT sender_id) FROM messages) AS senders, (SELECT count(*) FROM people) AS resolved,
    (SELECT count(DISTINCT sender_id) FROM messages) - (SELECT count(*) FROM people) AS unresolved, (SELECT count(*) FROM people WHERE source = 'manual') AS by_hand"""
)
def people_stats(spark: SparkSession, d: str) -> DataFrame:
    counts = people_counts(read_table(spark, d, "messages"), read_table(spark, d, "people"))
    return counts.select("senders", "resolved", "unresolved", F.coalesce(F.col("by_source")["manual"], F.lit(0)).alias("by_hand"))
