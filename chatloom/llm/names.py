"""What a corpus tells about the names of people, learned from the corpus itself.

Seeds are the names of known people. The texts show after which words those
seeds stand ("ask for", "pregunta por"): a context is one of names if the share
of its occurrences that lead to a known name is above a threshold at the lower
end of its confidence interval. They then tell which further words are given
names, because they open capitalised pairs in such contexts most of the time,
and which words are ordinary. All of it is counted over all rows and all seeds.

Every threshold is a rate, compared with the lower end of an estimate, so that
a rule means the same over a thousand rows and over a billion.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

CONTEXT_SHARE = 0.05  # of a context's occurrences that lead to a known name, at least
GIVEN_SHARE = 0.3  # of a word's capitalised pairs that stand in such a context, at least
LOWER_RATE, CAPITAL_RATE = 8e-6, 3e-5  # of all words: one this often small, or capitalised, is ordinary
LOWER_SHARE = 0.25  # of an ordinary word's own occurrences that are small, at least; a name is now and then
PART_SHARE = 1e-4  # of the family names that begin or end alike, for compounds: at most 10,000 beginnings and ends
MOST_NAMES = 500_000  # names that are sent to every worker; more are joined to the rows that hold them
MOST_CONTEXTS = 200_000  # contexts likewise
Z = 1.64

TOKEN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
LABEL = re.compile(r"^(?:[^\S\n]*>)*[^\S\n]*\[\d{4}-\d\d-\d\d \d\d:\d\d(?::\d\d)?\] [^:\n]*:(?= |$)", re.M)
_PLAIN = re.compile(r"(?<![@._+'\w-])[^\W\d_]{2,}(?:['-][^\W\d_]+)*(?![@._+\w])")
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĽŁŃŅŇŌŐŒŔŘŚŞŠŤŪŮŰŲŹŻŽА-ЯЁІЇЄҐΑ-Ω"
TITLE = re.compile(rf"(?<![\w.'-])[{_UPPER}][^\W\d_]*+(?:['-][^\W\d_]+)*+")
_STOPS = re.compile(r"[.!?…\x01]")
REACH = 64  # characters before a name in which the two words of its context are looked for


def least_share(hits: float, n: float, z: float = Z) -> float:
    """The lower end of the confidence interval of a share (Wilson)."""
    if n <= 0:
        return 0.0
    p = hits / n
    return max(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def _least_share(hits: str, n: Column) -> Column:
    """``least_share`` of columns."""
    p = F.col(hits) / n
    return F.when(n > 0, (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)).otherwise(0.0)


def contexts_before(text: str, at: int) -> tuple[str, ...]:
    """The contexts of what stands at a place: the word before it and the two words before it, on its line and in its sentence."""
    line = max(text.rfind("\n", max(0, at - REACH), at) + 1, at - REACH)
    before = text[max(0, line) : at]
    stop = 0
    for m in _STOPS.finditer(before):
        stop = m.end()
    words = [m.group().lower() for m in TOKEN.finditer(before, stop)][-2:]
    if not words:
        return ()
    return (words[-1], " ".join(words)) if len(words) > 1 else (words[-1],)


@dataclass(frozen=True)
class Lexicon:
    """Given names, family names, the ordinary words of the corpus, and the contexts of names. All in small letters.

    ``heads`` and ``tails``: four letters that family names begin and end with.
    """

    given: frozenset[str]
    family: frozenset[str]
    words: frozenset[str]
    contexts: frozenset[str] = frozenset()
    heads: frozenset[str] | None = None
    tails: frozenset[str] | None = None

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, frozenset(value))
        put("given", self.given)
        put("family", (f for f in self.family if len(f) >= 4))
        put("words", self.words)
        put("contexts", self.contexts)
        put("heads", (f[:4] for f in self.family) if self.heads is None else self.heads)
        put("tails", (f[-4:] for f in self.family) if self.tails is None else self.tails)
        # words that can stand in a name, as they are or as part of a compound
        put("names", self.given | {p for f in self.family for p in (f, *re.split("['-]", f))})

    def among(self, known: list[tuple[str, bool, bool]]) -> Lexicon:
        """This one with the names (word, is given, is family) of one row."""
        return Lexicon(frozenset(w for w, g, _ in known if g), frozenset(w for w, _, f in known if f), self.words, self.contexts, self.heads, self.tails)

    def in_contexts(self, contexts: list[str]) -> Lexicon:
        """This one with the contexts of one row."""
        other = copy.copy(self)
        object.__setattr__(other, "contexts", frozenset(contexts))
        return other

    def ordinary(self, word: str) -> bool:
        return word in self.words

    def no_mailbox(self, word: str) -> bool:
        return word in self.words and word not in self.names

    def leads_to_name(self, text: str, at: int) -> bool:
        return any(c in self.contexts for c in contexts_before(text, at))

    def compound(self, low: str) -> bool:
        """The start of one listed name with the end of another."""
        return len(low) >= 7 and low[:4] in self.heads and low[-4:] in self.tails

    def known_family(self, low: str) -> bool:
        """In the list, or made of listed ones; an ordinary word never."""
        if low in self.words:
            return False
        if low in self.given:
            return low in self.family
        return low in self.family or self.compound(low)

    def misspelled(self, low: str) -> bool:
        """One letter away from an ordinary word, or that with a letter drawn out."""
        words = self.words
        squeezed = re.sub(r"(.)\1+", r"\1", low)
        if squeezed != low and (squeezed in words or any(squeezed[:i] + squeezed[i - 1] + squeezed[i:] in words for i in range(1, len(squeezed) + 1))):
            return True
        letters = set(low) | set("abcdefghijklmnopqrstuvwxyz" if low.isascii() else "абвгдежзийклмнопрстуфхцчшщъыьэюя")
        for i in range(len(low) + 1):
            a, b = low[:i], low[i:]
            if b and a + b[1:] in words or len(b) > 1 and a + b[1] + b[0] + b[2:] in words:
                return True
            for c in letters:
                if a + c + b in words or b and a + c + b[1:] in words:
                    return True
        # two words that lost their space
        return any(low[:i] in words and low[i:] in words for i in range(2, len(low) - 1))

    def family_like(self, token: str) -> bool:
        """Whether a word next to a given name can be the family name."""
        token = token[:-2] if token.endswith("'s") else token
        parts = [p for p in re.split("[-']", token) if p] or [token]
        low = [p.lower() for p in parts]
        if all(self.known_family(p) for p in low):
            return True
        whole = token.lower()
        if whole in self.family and token[0].isupper() and not token.isupper():
            return True  # a family name that is an ordinary word as well needs its capital
        if len(whole) < 4 or whole in self.given or whole in self.words or any(p in self.words for p in low if len(p) > 3):
            return False
        if token[0].isupper() and not token.isupper():
            return not self.misspelled(whole)
        return len(whole) >= 6 and not self.misspelled(whole)


# ---------------------------------------------------------------- learning


def pairs_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, first, last) of the capitalised pairs of a text; "Last, First" counts as well."""
    begin, end, word = -1, -1, ""
    for m in TITLE.finditer(text):
        a, b = m.span()
        gap = a - end
        if 0 < gap <= 2 and len(word) > 1 and b - a > 1 and (gap == 1 and text[end] == " " or gap == 2 and text[end:a] == ", "):
            other = m.group()
            if not (word.isupper() or other.isupper()):
                first, last = (word, other) if gap == 1 else (other, word)
                if len(first) > 2 and len(last) > 3:
                    yield begin, b, first, last
        begin, end, word = a, b, m.group()


def _unlabelled(text: str) -> str:
    return LABEL.sub("\x01", text) if "[" in text else text


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for t in batch.column(0):
            if text := t.as_py():
                yield _unlabelled(text)


MOST_COUNTED = 200_000  # different things that a task counts before it passes them on


def words_and_pairs(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(first, last, one, two, lower, capital, n): the words and the capitalised pairs of all rows.

    A row without ``last`` is a word, with how often it comes in small letters
    and with a capital. Any other is a pair in the contexts ``one`` and ``two``,
    as far as there are any, with how often it comes. All in small letters.
    """
    names = ["first", "last", "one", "two", "lower", "capital", "n"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 3

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown: Counter = Counter()
        pairs: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words: dict[str, list[int]] = {}
            for word, n in shown.items():
                if not word.isupper():  # shouting tells nothing
                    low = word.lower()
                    words.setdefault(low, [0, 0])[word[0] != low[0]] += n
            rows = [(w, None, None, None, *counts, 0) for w, counts in words.items()] + [(*pair, 0, 0, n) for pair, n in pairs.items()]
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

        for text in _texts_of(batches):
            shown.update(_PLAIN.findall(text))
            for at, _, first, last in pairs_of(text):
                pairs[(first.lower(), last.lower(), *contexts_before(text, at), None, None)[:4]] += 1
            if len(shown) + len(pairs) > MOST_COUNTED:
                yield flush()
                shown.clear()
                pairs.clear()
        if shown or pairs:
            yield flush()

    rows = texts.select(text_col).mapInArrow(fn, "first string, last string, one string, two string, lower bigint, capital bigint, n bigint")
    return rows.groupBy("first", "last", "one", "two").agg(*[F.sum(c).alias(c) for c in names[4:]])


_TOKEN_OR_BREAK = re.compile(rf"{TOKEN.pattern}|\n")


def occurrences(texts: DataFrame, contexts: frozenset[str] | None, text_col: str = "text") -> DataFrame:
    """(key, n): how often each word, and each two words of a line, come in all rows; of all of them, or of ``contexts`` only."""
    share = texts.sparkSession.sparkContext.broadcast(contexts)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = share.value
        one: Counter = Counter()
        two: Counter = Counter()

        def flush() -> pa.RecordBatch:
            counter: Counter = Counter()
            for word, n in one.items():
                counter[word.lower()] += n
            for (a, b), n in two.items():
                if a != "\n" and b != "\n":
                    counter[f"{a.lower()} {b.lower()}"] += n
            del counter["\n"]
            kept = [(c, n) for c, n in counter.items() if wanted is None or c in wanted]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["key", "n"])

        for text in _texts_of(batches):
            words = _TOKEN_OR_BREAK.findall(text)
            one.update(words)
            two.update(zip(words, words[1:]))
            if len(one) + len(two) > MOST_COUNTED:
                yield flush()
                one.clear()
                two.clear()
        if one:
            yield flush()

    return texts.select(text_col).mapInArrow(fn, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _few(keys: DataFrame) -> frozenset[str] | None:
    """The contexts of a table, or none if they are too many to be sent to every worker."""
    rows = keys.select("key").limit(MOST_CONTEXTS + 1).collect()
    return frozenset(r.key for r in rows) if len(rows) <= MOST_CONTEXTS else None


def learn_contexts(texts: DataFrame, pairs: DataFrame, given: DataFrame, text_col: str = "text") -> DataFrame:
    """(key): the contexts of names, from all texts, their ``pairs`` and all ``given`` names (key) of known people.

    A context is the word, or the two words, before a name. It counts if known
    names follow it twice or more and in ``CONTEXT_SHARE`` of its occurrences,
    at the lower end of the confidence interval.
    """
    led = pairs.join(given.select(F.col("key").alias("first")), "first", "left_semi").join(given.select(F.col("key").alias("last")), "last", "left_anti")
    hits = led.select(F.explode(F.array("one", "two")).alias("key"), "n").where("key is not null").groupBy("key").agg(F.sum("n").alias("hits")).where("hits >= 2")
    hits = cut_lineage(hits)
    wanted = _few(hits)
    if wanted == frozenset():
        return hits.select("key")
    shares = hits.join(occurrences(texts, wanted, text_col), "key", "left")
    return cut_lineage(shares.where(_least_share("hits", F.greatest("hits", F.coalesce("n", F.lit(0)))) >= CONTEXT_SHARE).select("key"))


def word_statistics(counted: DataFrame, contexts: DataFrame, given: DataFrame) -> DataFrame:
    """(key, lower, capital, paired, led, named) of each word of ``words_and_pairs``.

    How often it comes in small letters and with a capital, how often it is the
    first name of a capitalised pair, how often of one in a context of names, and
    how often it is either word of a pair in such a context or with one of the
    known ``given`` names. Beside a known given name a word rather is a family
    name, which doesn't count as a first one.
    """
    pairs = counted.where("last is not null").select(*[F.regexp_replace(c, "'s$", "").alias(c) for c in ("first", "last")], "one", "two", "n")
    for column, keys in (("first", given), ("last", given), ("one", contexts), ("two", contexts)):
        known = keys.select(F.col("key").alias(column), F.lit(True).alias(f"known_{column}"))
        pairs = pairs.join(known, column, "left").withColumn(f"known_{column}", F.coalesce(f"known_{column}", F.lit(False)))
    led = F.col("known_one") | F.col("known_two")
    times = lambda condition: F.when(condition, F.col("n")).otherwise(0)
    named = times(led | F.col("known_first") | F.col("known_last")).alias("named")
    roles = F.array(
        F.struct(F.col("first").alias("key"), times(~F.col("known_last")).alias("paired"), times(~F.col("known_last") & led).alias("led"), named),
        F.struct(F.col("last").alias("key"), F.lit(0).cast("bigint").alias("paired"), F.lit(0).cast("bigint").alias("led"), named),
    )
    in_pairs = pairs.select(F.explode(roles).alias("r")).select("r.*")
    words = counted.where("last is null").select(F.col("first").alias("key"), "lower", "capital")
    columns = ["lower", "capital", "paired", "led", "named"]
    return words.unionByName(in_pairs, allowMissingColumns=True).groupBy("key").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


@dataclass(frozen=True)
class Names:
    """A lexicon, and where its names or its contexts are too many to be sent to every worker, their tables (word, given, family) and (key)."""

    lexicon: Lexicon
    table: DataFrame | None = None
    contexts: DataFrame | None = None


def learn_names(texts: DataFrame, people: DataFrame, senders: DataFrame | None = None, text_col: str = "text") -> Names:
    """What ``texts`` and the known people tell about names.

    Given and family names come from two-word display names and sender labels
    (two capitals, letters only), further given names from the texts. Ordinary
    words are those whose rate is at least ``LOWER_RATE`` in small letters or,
    outside of names, ``CAPITAL_RATE`` with a capital, at two and three standard
    deviations: by that rule at most 1 / LOWER_RATE words. Names are sent to every worker up
    to ``MOST_NAMES``, contexts up to ``MOST_CONTEXTS``; more are kept as tables.
    Null names and texts tell nothing.
    """
    shown = people.select(F.col("display_name").alias("shown"))
    if senders is not None:
        shown = shown.unionByName(senders.select(F.col("sender").alias("shown")))
    part = r"\p{Lu}\p{Ll}+(?:['’-]\p{L}+)?"
    tidy = F.trim(F.regexp_replace("shown", r"[^\p{L}\p{N}'’.\- ]+|\s+", " "))
    parts = shown.select(F.regexp_replace(tidy, " +", " ").alias("shown"))
    first = F.lower(F.regexp_extract("shown", rf"^({part})(?: (?:{part}|\p{{Lu}}\.?))?$", 1))
    last = F.lower(F.regexp_extract("shown", rf"^{part} ({part})$", 1))
    seen = cut_lineage(parts.select(first.alias("given"), last.alias("family")).where("given <> ''").distinct())
    given = seen.groupBy(F.col("given").alias("key")).agg(F.max((F.col("family") != "").cast("int")).alias("sure"))
    sure = given.where("sure = 1").select("key")
    counted = cut_lineage(words_and_pairs(texts, text_col))
    led_by = learn_contexts(texts, counted.where("last is not null"), sure, text_col)
    contexts = _few(led_by)
    kept = led_by if contexts is None else None
    contexts = contexts or frozenset()

    counts = cut_lineage(word_statistics(counted, led_by, sure))
    total = counts.agg(F.sum(F.col("lower") + F.col("capital"))).first()[0] or 0
    least = lambda c, z: F.col(c) - z * F.sqrt(F.col(c))
    counts = counts.withColumn("bare", F.greatest(F.lit(0), F.col("capital") - F.col("named")))
    small = (least("lower", 2) > LOWER_RATE * total) & (_least_share("lower", F.col("lower") + F.col("capital")) >= LOWER_SHARE)
    is_given = (F.col("led") >= 2) & (_least_share("led", F.col("paired")) >= GIVEN_SHARE) & (F.length("key") > 2)
    is_ordinary = small | (~is_given & (least("bare", 3) > CAPITAL_RATE * total))
    ordinary = counts.where(is_ordinary).select("key")
    words = frozenset(r.key for r in ordinary.collect())

    told = counts.where(is_given & ~is_ordinary)
    alone = given.where("sure = 0 and length(key) > 2").join(ordinary, "key", "left_anti").select("key")
    family = seen.where("family <> ''").select(F.col("family").alias("key")).distinct()
    listed = sure.unionByName(alone).distinct()
    all_given = listed.unionByName(told.select("key").join(family, "key", "left_anti")).distinct()
    family = family.join(listed, "key", "left_anti")
    table = cut_lineage(
        all_given.select("key", F.lit(True).alias("given"), F.lit(False).alias("family"))
        .unionByName(family.select("key", F.lit(False).alias("given"), F.lit(True).alias("family")))
        .groupBy(F.col("key").alias("word")).agg(F.bool_or("given").alias("given"), F.bool_or("family").alias("family"))
    )
    few = table.limit(MOST_NAMES + 1).collect()
    if len(few) <= MOST_NAMES:
        families = [r.word for r in few if r.family and len(r.word) >= 4]
        heads, tails = (_shared(Counter(part), len(families)) for part in ((f[:4] for f in families), (f[-4:] for f in families)))
        return Names(Lexicon(frozenset(r.word for r in few if r.given), frozenset(r.word for r in few if r.family), words, contexts, heads, tails), contexts=kept)
    families = table.where("family and length(word) >= 4")
    n = families.count()
    heads, tails = (
        _shared({r.part: r["count"] for r in families.groupBy(piece.alias("part")).count().where(F.col("count") >= PART_SHARE * n).collect()}, n)
        for piece in (F.substring("word", 1, 4), F.substring("word", -4, 4))
    )
    return Names(Lexicon(frozenset(), frozenset(), words, contexts, heads, tails), table, kept)


def _shared(parts: dict[str, int], n: int) -> frozenset[str]:
    """The beginnings or ends that enough of ``n`` family names have."""
    return frozenset(part for part, count in parts.items() if count >= max(1.0, PART_SHARE * n))
