"""Splitting oversized transcripts at natural boundaries, by lexical cohesion.

A text over the limit is cut into units (lines and sentences). The words of the
blocks on both sides of each gap between units are compared; a valley in that
similarity marks a change of topic. Each piece ends at the deepest valley its
size allows, ends of messages and paragraphs counting for more, and the next
piece begins 100 to 200 characters earlier.

Which message a character belongs to is found by aligning the text with the
messages themselves: their times give the headers to expect, and the lengths
and hashes of their known texts say where each one ends, so that transcripts
pasted into a message stay part of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2_000
OVERLAP = (100, 200)
BLOCK = 6  # units on each side of a gap

_HEAD = r"\[\d{4}-\d\d-\d\d \d\d:\d\d\] "
_HEADER = re.compile(rf"^{_HEAD}", re.M)
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'»”’)\]]*[ \t\xa0\u3000]+(?=\S)|\n+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def hash_of(text: str) -> int:
    """Spark's ``xxhash64`` of one string."""
    import xxhash

    value = xxhash.xxh64_intdigest(text.encode("utf-8"), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


def align(text: str, turns: list[tuple[int, int, list[tuple[int, int]]]]) -> list[tuple[int, int, int]]:
    """(msg_id, begin, end) of each message in a transcript, in order.

    ``turns``: (ts, msg_id, [(length, hash) of each known text]) in order. A
    message whose shown text isn't known ends where the next expected header
    stands. Without turns every header line in order of time begins a message.
    """
    size = len(text)
    heads = [m.start() for m in _HEADER.finditer(text)]
    if not turns:
        begins, last = [], ""
        for p in heads:
            stamp = text[p : p + 18]
            if stamp >= last:
                begins.append(p)
                last = stamp
        begins = begins or [0]
        return [(-1, a, b) for a, b in zip(begins, [*begins[1:], size])]
    by_stamp: dict[str, list[int]] = {}
    for p in heads:
        by_stamp.setdefault(text[p : p + 19], []).append(p)
    out: list[tuple[int, int, int]] = []
    pos = 0
    for ts, msg, texts in turns:
        stamp = datetime.fromtimestamp(ts, timezone.utc).strftime("[%Y-%m-%d %H:%M] ")
        if not text.startswith(stamp, pos):
            # the message before was unknown, or longer than thought: go to the next header of this minute
            places = by_stamp.get(stamp, [])
            at = bisect_left(places, pos)
            if at == len(places):
                continue
            pos = places[at]
        body = pos + len(stamp)
        stop = text.find("\n", body)
        stop = size if stop < 0 else stop
        end = -1
        colon = text.find(": ", body, stop + 2)
        while colon >= 0:
            for length, value in texts:
                tail = colon + 2 + length
                if tail > end and (tail == size or text.startswith("\n[", tail)) and hash_of(text[colon + 2 : tail]) == value:
                    end = tail
            colon = text.find(": ", colon + 1, stop + 2)
        if out and out[-1][2] < 0:
            out[-1] = (out[-1][0], out[-1][1], pos)
        out.append((msg, pos, end))
        pos = body if end < 0 else min(size, end + 1)
    if out:
        # messages run up to the next one's header
        begins = [b for _, b, _ in out]
        out = [(m, b, n) for (m, b, _), n in zip(out, [*begins[1:], size])]
    return out or [(-1, 0, size)]


def depths(text: str, gaps: list[int], block: int = BLOCK) -> np.ndarray:
    """How deep the similarity of the blocks around each gap lies under the peaks on both sides.

    A word's entry meets at most ``2 * block`` others, so that time and memory
    are in proportion to the words, whatever their number.
    """
    n = len(gaps) + 1
    if n < 3:
        return np.zeros(len(gaps))
    words: dict[str, int] = {}
    low = text.lower()
    found = [(m.start(), words.setdefault(m.group(), len(words))) for m in _WORD.finditer(low if len(low) == len(text) else text)]
    if not found:
        return np.zeros(len(gaps))
    place, word = np.array(found, dtype=np.int64).T
    unit = np.searchsorted(np.array(gaps), place, side="right")
    held, count = np.unique(word * n + unit, return_counts=True)  # one entry for each word of each unit, by word and unit
    word, unit = np.divmod(held, n)
    # a pair of entries of one word adds to the blocks of a stretch of gaps: sums of its beginnings and ends
    dot, left, right = (np.zeros(n + block + 1) for _ in range(3))
    for step in range(min(2 * block, len(held))):
        a, b = unit[: len(unit) - step], unit[step:]
        near = (word[: len(word) - step] == word[step:]) & (b - a < 2 * block)
        a, b = a[near], b[near]
        weight = (count[: len(count) - step] * count[step:])[near].astype(np.float64)
        if step:  # one on each side of the gap
            np.add.at(dot, np.maximum(a, b - block) + 1, weight)
            np.add.at(dot, np.minimum(b, a + block) + 1, -weight)
        both = b - a < block  # both on one side
        a, b, weight = a[both], b[both], weight[both] * (2 if step else 1)
        np.add.at(left, b + 1, weight)
        np.add.at(left, a + block + 1, -weight)
        np.add.at(right, np.maximum(b - block + 1, 0), weight)
        np.add.at(right, a + 1, -weight)
    dot, left, right = (np.cumsum(x)[1:n] for x in (dot, left, right))
    norm = np.sqrt(left * right)
    sim = np.where(norm > 0, dot / np.maximum(norm, 1e-9), 0.0)
    # climb to the nearest peak on either side
    values = sim.tolist()
    up_left, up_right = values.copy(), values.copy()
    for i in range(1, len(values)):
        if values[i - 1] >= values[i]:
            up_left[i] = up_left[i - 1]
    for i in range(len(values) - 2, -1, -1):
        if values[i + 1] >= values[i]:
            up_right[i] = up_right[i + 1]
    return np.array(up_left) + np.array(up_right) - 2 * sim


def split(text: str, begins: list[int], limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int, str]]:
    """(begin, end, boundary) of the pieces of a text; ``begins``: where its messages begin.

    boundary: message, paragraph, sentence, word, none, or end.
    """
    if not 0 < overlap[0] <= overlap[1] < limit // 2:
        raise ValueError("the overlap must be positive and under half the limit")
    size = len(text)
    rank: dict[int, int] = {m.end(): (2 if m.group().startswith("\n") else 1) for m in _SENTENCE.finditer(text)}
    rank.update({b: 3 for b in begins if 0 < b < size})
    rank.pop(size, None)
    gaps = sorted(rank)
    depth = depths(text, gaps)
    worth = depth + np.array([(0.0, 0.0, 0.4, 1.0)[rank[g]] for g in gaps]) if gaps else np.zeros(0)
    place = np.array(gaps, dtype=np.int64)
    names = ("word", "sentence", "paragraph", "message")
    out: list[tuple[int, int, str]] = []
    start = 0
    while size - start > limit:
        end, kind = -1, "none"
        for least in (limit // 2, overlap[1] + 1):
            a, b = np.searchsorted(place, start + least), np.searchsorted(place, start + limit, side="right")
            if a < b:
                end = int(place[a + int(worth[a:b].argmax())])
                kind = names[rank[end]]
                break
        if end < 0:
            cut = start + limit
            spaces = [m.end() for m in _SPACE.finditer(text, start + overlap[1] + 1, cut)]
            if spaces:
                end, kind = spaces[-1], "word"
            else:
                end = cut
                while end > start + overlap[1] + 1 and _joins(text[end]):  # not between a letter and its marks
                    end -= 1
                if end == start + overlap[1] + 1:
                    end = cut
        out.append((start, end, kind))
        low, high = end - overlap[1], end - overlap[0]
        options = [g for g in gaps[np.searchsorted(place, low) : np.searchsorted(place, high, side="right")]]
        if options:
            start = max(options, key=lambda g: (rank[g], g))
        else:
            spaces = [m.end() for m in _SPACE.finditer(text, low, high)]
            start = spaces[-1] if spaces else (low + high) // 2
    out.append((start, size, "end"))
    return out


def _joins(char: str) -> bool:
    import unicodedata

    return unicodedata.combining(char) > 0 or char in "\u200d\ufe0f"


_PIECES = (
    "window_id bigint, piece int, first_char bigint, last_char bigint, first_msg bigint, last_msg bigint, "
    "boundary string, cut string, text string"
)


def oversized_pieces(windows: DataFrame, messages: DataFrame, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> DataFrame:
    """The pieces of every window whose text has more than ``limit`` code points.

    window_id, piece (from 1), first_char and last_char (0-based, inclusive),
    first_msg and last_msg covered, boundary (what the piece ends at), cut
    (``inside`` if a message as rendered is itself over the limit, else
    ``between``), text. Pieces have at most ``limit`` code points, each but the
    first shares ``overlap`` characters with the one before, and together they
    cover the text.

    Windows with a null id or text, or short enough, have no row. Where the
    messages of a window are missing, headers in order of time stand for them
    and first_msg and last_msg are the window's own. Every delivery of a message
    is a text it may show; rows of messages without chat, msg_id, ts or text are
    no help and are left out. Rows of equal window ids are split each.
    """
    long = windows.where(F.col("id").isNotNull() & (F.length("text") > limit)).select(
        F.col("id").alias("window_id"), "chat_id", "first_msg", "last_msg", "ts_start", "ts_end", "text"
    )
    stamp = F.col("stamp")
    minute = F.expr("unix_date(try_cast(substr(stamp, 1, 10) AS date)) * 1440L + try_cast(substr(stamp, 12, 2) AS int) * 60 + try_cast(substr(stamp, 15, 2) AS int)")
    headers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\[(\d{4}-\d\d-\d\d \d\d:\d\d)\] "), F.lit(1)))
    asked = (
        long.select("window_id", "chat_id", "ts_start", "ts_end", F.explode(headers).alias("stamp"))
        .withColumn("minute", minute)
        .drop(stamp)
        .where("minute between floor(ts_start / 60) and floor(ts_end / 60)")
        .distinct()
    )
    known = messages.dropna(subset=["chat_id", "msg_id", "ts", "text"]).select(
        "chat_id", "msg_id", "ts", F.floor(F.col("ts") / 60).alias("minute"), F.length("text").alias("size"), F.xxhash64("text").alias("hash")
    )
    turns = (
        asked.join(known, ["chat_id", "minute"]).where("ts between ts_start and ts_end")
        .groupBy("window_id").agg(F.collect_set(F.struct("ts", "msg_id", "size", "hash")).alias("turns"))
    )  # a window's own messages
    rows = long.join(turns, "window_id", "left").select(
        "window_id", "first_msg", "last_msg", "ts_start", "ts_end", "text",
        F.col("turns.ts").alias("ts"), F.col("turns.msg_id").alias("msg"), F.col("turns.size").alias("size"), F.col("turns.hash").alias("hash"),
    )

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                by: dict[tuple[int, int], list[tuple[int, int]]] = {}
                low, high = (r["ts_start"], r["first_msg"]), (r["ts_end"], r["last_msg"])
                whole = None not in (*low, *high)
                for ts, msg, size, value in zip(*(r[c] or () for c in ("ts", "msg", "size", "hash"))):
                    if whole and low <= (ts, msg) <= high:
                        by.setdefault((ts, msg), []).append((size, value))
                spans = align(r["text"], [(ts, msg, texts) for (ts, msg), texts in sorted(by.items())])
                text = r["text"]
                # a message ends before the line break that leads to the next header
                widest = max(e - b - (e < len(text)) for _, b, e in spans)
                cut = "inside" if widest > limit else "between"
                begins = np.array([b for _, b, _ in spans])
                for i, (a, b, kind) in enumerate(split(text, begins.tolist(), limit, overlap), 1):
                    first = spans[max(0, int(np.searchsorted(begins, a, side="right")) - 1)][0]
                    last = spans[max(0, int(np.searchsorted(begins, b, side="left")) - 1)][0]
                    out.append((r["window_id"], i, a, b - 1, r["first_msg"] if first < 0 else first, r["last_msg"] if last < 0 else last, kind, cut, text[a:b]))
            if out:
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return rows.mapInArrow(fn, _PIECES)
