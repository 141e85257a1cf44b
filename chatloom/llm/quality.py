"""Per-document text statistics, and the shape they give away: prose, list, table or junk.

A document is read by its lines. Each line is a row of fields, a short item, a
line of talk or writing, or machine output; repetition statistics (duplicate
lines and paragraphs, the characters covered by the most frequent word n-gram,
those of sentences and long runs of words that came before) and character
statistics catch what has nothing to read. Everything is computed over the
whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, filterfalse
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COMMON_WORDS = 100_000  # rows the word list may have; it goes to every worker

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*")  # the same in plain text
_QUOTE = re.compile(r"^\s*(?:>\s?)+")
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060\ufeff\ufe0f]")
# fixed values: marks that open a list item
_BULLET = re.compile(r"^\s*(?:[-*+•·–—‣▪▫◦●○■□★☆➤→✓✔✅☑✗]|#?\d{1,4}[.):]|#\d{1,4}|\(?[^\W\d_][.)]|\[[ xX✓]?\])[\s\xa0]+")
_COUNT = re.compile(r"^\s*\d+\s*[x×]\s+")
_URL = re.compile(r"^(?:https?://|www\.)\S+$")
# fixed values: what a sentence ends with, and what may close behind it
_ENDS = frozenset(".!?…。！？؟:;")
_CLOSERS = "'\"»”’)]"
_RULE = re.compile(r"^[\s|+\-=:_*]+$")
_TURN = re.compile(r"^\s*(?:\[[^\]\n]{4,30}\]\s*)?[^\W\d_][^:|;\t\n]{0,40}:\s+\S|^\s*\[\d[^\]\n]{3,30}\]\s*\S|^\s*[^\W\d_][^\n|;\t,]{0,40},\s*\d{1,2}:\d\d(?::\d\d)?\s*$")
_PREFIX = re.compile(r"^\s*(?:\[[^\]\n]{4,30}\]\s*)?(?:[^\W\d_][^:|;\t\n]{0,40}:\s+|[^\W\d_][^\n|;\t,]{0,40},\s*\d{1,2}:\d\d(?::\d\d)?\s*$)|^\s*\[[^\]\n]{4,30}\]\s*")
_CONTROL = re.compile("[\x1c-\x1e]")  # Python breaks lines there, this module doesn't
_WIDE = re.compile(r"\S {3,}\S")
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE = re.compile("(?<=[.!?…])\\s+|(?<=[。！？؟])\\s*|[\n\r\x0b\x0c\x85\u2028\u2029]+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_FILLED = re.compile(r"[^\W_]")
_HEADING = re.compile(r"^\s*#{1,6}\s+\S")
# tags, templates, bracket tags, entities, statements, and blocks of "property: value" after a selector; each ends before the next of its kind opens
_MARKUP = re.compile(
    r"<[/!]?[a-zA-Z](?:[^<>\n]|\n(?!\s*\n))*+>|\{\{[^{}]*+\}\}|\{%[^{}%]*+%\}|\[/?[a-z]{1,10}(?:=[^\[\]]*+)?\](?=\[|\S)|&(?:[a-z]{2,8}|#\d{1,6});|(?P<block>\{[^{}:]*+:[^{}]*+\})"
)
_SIGNS = re.compile(r"[<{&]|\[/?[a-z]")
_MACHINE = re.compile(r"[\d=:/\\{}<>\[\]_]")
_LINKS = ("http://", "https://", "www.")
_CODE = re.compile(r"^[\w+/=-]{30,}$")
_DELIMITERS = ("|", "\t", ";", ",")


def _ends(line: str) -> bool:
    """Whether a line without space at its end closes a sentence."""
    return line.rstrip(_CLOSERS)[-1:] in _ENDS


def markup_length(text: str) -> int:
    """Characters of tags, templates, comments and style blocks, in one pass over the text."""
    if not _SIGNS.search(text):
        return 0
    total = 0
    if "<!--" in text:
        kept, at = [], 0
        while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
            kept.append(text[at:begin])
            total += end + 3 - begin
            at = end + 3
        text = " ".join([*kept, text[at:]])
    last = 0
    for m in _MARKUP.finditer(text):
        begin, end = m.span()
        if m["block"] is not None:
            at = begin
            while at > last and text[at - 1].isspace():
                at -= 1
            begin = at
            while at > last and (text[at - 1].isalnum() or text[at - 1] in "_#.-"):
                at -= 1
            if at == begin:
                continue  # no selector
            begin = at
        total += end - begin
        last = end
    return total


MOST_CELL_WORDS = 6


def _table_lines(lines: list[str], sizes: list[int]) -> set[int]:
    """Lines that are rows of one table: at least three in a block, alike in their fields. ``sizes``: words of each line."""
    found: set[int] = set()
    if len(lines) < 3:
        return found
    whole = "\n".join(lines)
    for mark in (*_DELIMITERS, "  "):
        if whole.count(mark) < 3:
            continue
        runs: dict[int, list[int]] = {}
        headers: dict[int, list[int]] = {}
        loose: list[int] = []
        for i, line in enumerate(lines):
            if mark not in line or (mark in ",;" and sizes[i] > MOST_CELL_WORDS * (line.count(mark) + 1)):
                continue  # some cell has too many words
            if mark == "  ":
                if "  " not in line.strip():
                    continue
                cells = re.split(r"\s{2,}", line.strip())
            elif mark in line.strip():  # a leading tab is only an indent
                body = line.strip(" ")
                framed = mark == "|" and len(body) > 1 and body.startswith("|") and body.endswith("|")
                cells = (body[1:-1] if framed else body).split(mark)
            else:
                continue
            n = len(cells)
            if n < 2:
                continue
            if mark == "  " and _WIDE.search(line) and (n > 2 or any(not _LETTER.search(c) for c in cells)):
                loose.append(i)  # columns by spaces, some cells grown together
            words = max(len(c.split()) for c in cells)
            if words > MOST_CELL_WORDS or (mark in ",;  " and any(_ends(c.strip()) and len(c.split()) > 2 for c in cells)):
                continue
            if mark in ",;" and not any(c.strip() and not _LETTER.search(c) for c in cells):
                headers.setdefault(n, []).append(i)  # words between commas are a row only beside rows with figures
                continue
            runs.setdefault(n, []).append(i)
        for n, rows in runs.items():
            if mark == "," and n < 3:
                continue
            if len(rows) >= 3:
                found.update(rows)
                if len(headers.get(n, ())) <= len(rows):
                    found.update(headers.get(n, ()))
        if len(loose) >= 3:
            found.update(loose)
        if mark == "|" and found:
            found.update(i for i, line in enumerate(lines) if _RULE.match(line) and ("-" in line or "=" in line))
    return found


MOST_ITEM_WORDS = 40  # a mark, a count, seven words and a tail of 40 characters have fewer


def _item(line: str, size: int) -> bool:
    """A short item: marked and of few words, or unmarked and of very few, and not a sentence. ``size``: its words."""
    if size > MOST_ITEM_WORDS:
        return False
    mark = _BULLET.match(line)
    marked = mark is not None
    body = line[mark.end() :] if mark else line
    if body.lstrip()[:1].isdigit():
        body = _COUNT.sub("", body)
    body = body.strip()
    if body.endswith(")") and 1 <= len(tail := body[body.rfind("(") + 1 : -1]) <= 40 and ")" not in tail and "(" in body:
        body = body[: body.rfind("(")].rstrip()
    if not body:
        return marked
    if _URL.match(body):
        return True
    words = body.split()
    if len(words) > 2 and _ends(body):
        return False
    if "?" in body or "!" in body:
        return False
    return len(words) <= (7 if marked else 4)


def coverage(words: list[str]) -> float:
    """Share of the words' characters covered by the most frequent 1- to 4-gram that comes at least three times."""
    total = sum(map(len, words))
    best = 0.0
    counts: Counter = Counter(words)
    grams: list = words
    places: list[int] = []
    for n in (1, 2, 3, 4):
        count = max(counts.values(), default=0)
        if count < 3:
            break
        gram = next(g for g, c in counts.items() if c == count)
        parts = (gram,) if n == 1 else gram
        # overlapping hits of one gram cover each word once at most
        best = max(best, min(1.0, count * sum(map(len, parts)) / total) / (n if len(set(parts)) == 1 else 1))
        # a longer gram that comes three times is made of two that do
        if n == 1:
            often = {w for w, c in counts.items() if c >= 3}
            held = list(map(often.__contains__, words))
            both = list(map(and_, held, held[1:]))
            places, grams = list(compress(range(len(both)), both)), list(compress(zip(words, words[1:]), both))
        else:
            follows = {i for i, g in zip(places, grams) if counts[g] >= 3}
            places = [i for i in places if i in follows and i + 1 in follows]
            grams = [tuple(words[i : i + n + 1]) for i in places]
        counts = Counter(grams)
    return best


ENOUGH = 12  # words a text needs for its repetition to tell anything
FEW_DISTINCT = 0.3  # share of distinct words under which a text can be endless repetition
LONG = 24  # words of a run that is compared as a whole; prose from a template differs within so many


def repeated(text: str, words: list[str]) -> tuple[float, float]:
    """Share of the characters in sentences or lines, or in runs of LONG words, that stood in the text before; that of one sentence or line.

    Words the text has once can't be repeated, so that runs are looked at only
    where the others reach a half; below that the share may be less than that
    of the runs.
    """
    total = sum(map(len, words))
    if not total:
        return 0.0, 0.0
    first = total - sum(map(len, set(words)))  # the characters of words that came before
    units = Counter(_SENTENCE.split(text))
    sizes = [len("".join(u.split())) * (n - 1) for u, n in units.items() if n > 1]
    best, one = sum(sizes) / total, max(sizes, default=0) / total
    if first <= 0.5 * total or best > 0.8:
        return best, one
    seen: set[int] = set()
    size = end = 0
    for i in range(len(words) - LONG + 1):
        gram = hash(tuple(words[i : i + LONG]))
        if gram in seen:
            size += sum(map(len, words[max(i, end) : i + LONG]))
            end = i + LONG
        else:
            seen.add(gram)
    return max(best, size / total), one


def _odd_word(word: str) -> bool:
    """A word no one could read: mixed scripts, long runs of one letter or of consonants, or case chaos."""
    low = word.lower()
    latin = sum("a" <= c <= "z" for c in low)
    if latin and any("Ѐ" <= c <= "ӿ" for c in low):
        return True
    if re.search(r"(.)\1{3,}", low):
        return True
    if latin >= 4 and latin == len(low):
        if not re.search("[aeiouy]", low) or re.search("[bcdfghjklmnpqrstvwxz]{5,}", low):
            return True
    if sum("\u0080" <= c <= "ÿ" and not c.isalpha() for c in low):
        return True
    return bool(re.search(r"[a-z][A-Z].*[a-z][A-Z]", word))


# fixed values: letters of a keyboard row lie side by side
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю", "qwertzuiopü", "asdfghjklöä", "yxcvbnm")
_NEAR = {a + b for row in _ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}


def _near(word: str) -> int:
    """Neighbouring letters of a word that are the same key or keys side by side."""
    return sum(a == b or a + b in _NEAR for a, b in zip(word, word[1:]))


REMEMBERED = 200_000  # words whose facts a worker remembers
_facts: dict[str, tuple[str, int, bool]] = {}


def word_facts(word: str) -> tuple[str, int, bool]:
    """A word in small letters, its pairs of near keys, and whether no one could read it."""
    if len(_facts) >= REMEMBERED:
        _facts.clear()
    low = word.lower()
    facts = (low, _near(low), _odd_word(word))
    if len(word) <= 64:
        _facts[word] = facts
    return facts


# fixed values: letters that a UTF-8 text shows when it is read in a one-byte code page
_MOJIBAKE = re.compile("[ÃÂÐÑâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|Р[°-џ\xa0-¿]С|[РС][\u0080-¿‚ѓ„…†‡€‰‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈ¤Ґ¦§Ё©Є«¬®Ї°±Ііґµ¶·ё№є»јЅѕї]")


def statistics(text: str | None, common: set[str]) -> dict:
    """The statistics of one text; a null text counts as an empty one."""
    text = text or ""
    ascii_only = text.isascii()
    clear = text if ascii_only else _INVISIBLE.sub("", text).replace("\xa0", " ")
    lines = _BREAK.split(clear) if _CONTROL.search(clear) else clear.splitlines()
    if ">" in clear:
        lines = [_QUOTE.sub("", line) for line in lines]
    lines = [line for line in lines if line and not line.isspace()]
    words = (_ASCII_WORD if ascii_only else _WORD).findall(clear)
    tokens = clear.split()
    kinds = Counter(words)
    known, near, pairs, odd, usual = _facts, 0, 0, 0, 0
    distinct: set[str] = set()
    for word, count in kinds.items():
        low, keys, strange = known.get(word) or word_facts(word)
        distinct.add(low)
        pairs += count * (len(low) - 1)
        near += count * keys
        if strange:
            odd += count
        if low in common:
            usual += count
    solid = "".join(tokens)
    joined = "".join(words)
    letters = len(joined) - joined.count("'") - joined.count("’") - joined.count("-")
    digits = len(_DIGIT.findall(clear))
    paragraphs = [p for p in _PARAGRAPH.split(clear.replace("\r\n", "\n").replace("\r", "\n")) if p.strip()] if len(lines) > 1 else lines
    n = len(lines)
    s = {
        "n_chars": len(text),
        "n_lines": n,
        "word_count": len(words),
        "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_ratio": (len(solid) - letters - digits) / len(solid) if solid else 0.0,
        "digit_ratio": digits / len(solid) if solid else 0.0,
        "end_punct_share": sum(_ends(line.rstrip()) for line in lines) / n if n else 0.0,
        "common_word_share": usual / len(words) if words else 0.0,
        "dup_line_share": 1 - len(set(lines)) / n if n else 0.0,
        "dup_paragraph_share": 1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        "ngram_coverage": coverage(clear.lower().split()),
        "distinct_word_share": len(distinct) / len(words) if words else 0.0,
    }
    s["markup_ratio"] = markup_length(clear) / len(clear) if clear else 0.0
    s["long_token_ratio"] = sum(len(t) for t in tokens if len(t) >= 30 and _CODE.match(t)) / len(solid) if tokens and max(map(len, tokens)) >= 30 else 0.0
    sizes = [len(line.split()) for line in lines]
    table = _table_lines(lines, sizes)
    turns = {i for i, line in enumerate(lines) if (":" in line or "[" in line) and _TURN.match(line)}
    spoken = clear if not turns else "\n".join(_PREFIX.sub("", line, count=1) for line in lines)
    # for the shape only, which asks for them where few words are distinct
    s["n_tokens"] = len(tokens)
    s["said_coverage"] = s["repeated_share"] = s["one_repeated_share"] = 0.0
    if s["distinct_word_share"] < FEW_DISTINCT:
        said = spoken.lower()
        said_words = said.split()
        s["repeated_share"], s["one_repeated_share"] = repeated(said, said_words)
        # of talk, what is said: its labels are alike; a few lines of it may be
        s["said_coverage"] = coverage(said_words) if len(said_words) >= 40 else 0.0
    plain = tokens if spoken is clear else spoken.split()
    signed = list(filterfalse(str.isalpha, plain))
    links = sum(t.startswith(_LINKS) for t in signed) if "://" in spoken or "www." in spoken else 0
    machine = sum(1 for t in signed if len(t) > 1 and _MACHINE.search(t) and not (links and t.startswith(_LINKS)))
    s["machine_token_ratio"] = machine / (len(plain) - links) if len(plain) > links else 0.0
    s["keyboard_share"] = near / pairs if pairs else 0.0
    s["odd_word_share"] = odd / len(words) if words else 0.0
    s["mojibake_ratio"] = 2 * len(_MOJIBAKE.findall(clear)) / len(solid) if solid and not ascii_only else 0.0
    items = {i for i, line in enumerate(lines) if i not in table and i not in turns and _item(line, sizes[i])}
    s["table_line_share"] = len(table - turns) / n if n else 0.0
    s["item_line_share"] = len(items) / n if n else 0.0
    s["turn_line_share"] = len(turns) / n if n else 0.0
    s["writing_chars"] = sum(len(line) for i, line in enumerate(lines) if sizes[i] > 4 and i not in table and i not in items)
    s["filled_table_lines"] = sum(bool(_FILLED.search(lines[i])) for i in table) / len(table) if table else 0.0
    s["table_chars"] = sum(len(lines[i]) for i in table)
    s["item_chars"] = sum(len(lines[i]) for i in items)
    return s


def shape_of(s: dict) -> str | None:
    """prose, list, table or junk; None for a text without anything but white space."""
    if not s["n_lines"]:
        return None
    copies = max(s["dup_line_share"], s["dup_paragraph_share"])
    if s["n_tokens"] >= ENOUGH and s["distinct_word_share"] < FEW_DISTINCT:
        share = s["repeated_share"]
        if s["table_line_share"] > 0.5 or s["item_line_share"] > 0.5:
            share = s["one_repeated_share"]  # rows and items of few kinds may come often
        if s["said_coverage"] > 0.5 or share > (0.5 if copies > 0.8 else 0.8):
            return "junk"
    if s["turn_line_share"] > 0.4 and s["word_count"] and s["machine_token_ratio"] < 0.5 and s["odd_word_share"] < 0.35 and s["markup_ratio"] < 0.35 and s["mojibake_ratio"] < 0.2:
        return "prose"
    if s["markup_ratio"] > 0.35 or s["long_token_ratio"] > 0.4 or s["mojibake_ratio"] > 0.2:
        return "junk"
    if s["n_tokens"] >= ENOUGH and s["ngram_coverage"] > 0.5 and s["distinct_word_share"] < FEW_DISTINCT:
        return "junk"
    # boilerplate: lines or paragraphs that are mostly copies of one another, the fewer of them the less they end like sentences
    lines = 2 / 3 if s["end_punct_share"] > 0.1 else 0.5 if s["common_word_share"] > 0.1 else 0.35
    copied = s["dup_paragraph_share"] >= 0.5 or s["dup_line_share"] >= lines
    if s["n_lines"] >= 4 and copied and s["item_line_share"] <= 0.5 and s["table_line_share"] <= 0.5:
        return "junk"
    # a short list or table between paragraphs can have most of the lines, but not most of what is written
    outweighs = lambda part: s[f"{part}_line_share"] > 0.8 or s[f"{part}_chars"] >= 0.7 * s["writing_chars"]
    if s["table_line_share"] > 0.5 and outweighs("table") and s["keyboard_share"] <= 0.5 and s["filled_table_lines"] > 0.5:
        return "table"
    if s["symbol_ratio"] > 0.5 or not s["word_count"]:
        return "junk"
    if s["machine_token_ratio"] > 0.5 and s["item_line_share"] < 0.5:
        return "junk"
    if s["keyboard_share"] > 0.5 and s["common_word_share"] < 0.1:
        return "junk"
    if s["odd_word_share"] > 0.35 and s["common_word_share"] < 0.1:
        return "junk"
    if s["item_line_share"] > 0.5 and s["n_lines"] >= 3 and outweighs("item"):
        return "list"
    return "prose"


_COLUMNS = {
    "n_chars": "bigint", "n_lines": "bigint", "word_count": "bigint", "mean_word_length": "double", "symbol_ratio": "double",
    "digit_ratio": "double", "end_punct_share": "double", "common_word_share": "double", "dup_line_share": "double",
    "dup_paragraph_share": "double", "ngram_coverage": "double", "distinct_word_share": "double", "markup_ratio": "double",
    "long_token_ratio": "double", "machine_token_ratio": "double", "odd_word_share": "double", "keyboard_share": "double", "mojibake_ratio": "double",
    "table_line_share": "double", "item_line_share": "double", "turn_line_share": "double",
}


def text_quality(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics of each text, and ``shape``: a row per row of ``documents``.

    Null and blank texts have all statistics 0 and a null shape. ``common_words``
    (column word) may have up to 100,000 rows; more are refused. Other columns
    of either table are ignored; an empty table gives no row.
    """
    rows = common_words.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    common = documents.sparkSession.sparkContext.broadcast({r.word for r in rows})
    id_type = dict(documents.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()) + ", shape string"

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py(), common.value) for t in batch.column(1)]
            arrays = [pa.array([s[c] for s in found], pa.float64() if t == "double" else pa.int64()) for c, t in _COLUMNS.items()]
            shapes = pa.array([shape_of(s) for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, shapes], names=[id_col, *_COLUMNS, "shape"])

    return documents.select(id_col, text_col).mapInArrow(fn, schema)
