"""Personal information in free text: found, and replaced by typed placeholders.

The text runs through a chain of transducers that keep their offsets: invisible
characters fall away, letters and digits of other widths and alphabets become
plain ones, homoglyphs in mixed words become Latin, spelled digits become
digits, "at" and "dot" become what they stand for. Identifiers are detected in
the result, and their spans are mapped back to the source, where nothing else
is touched.

Names need knowledge of the corpus, which ``names`` learns: given and family
names, ordinary words, and the contexts that names stand in.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.names import LABEL, TITLE, TOKEN, Lexicon, Names, contexts_before, pairs_of
from chatloom.session import cut_lineage

KINDS = ("email", "phone", "id_number", "address", "name")

# ---------------------------------------------------------------- transducers


_LETTERS = re.compile(r"[^\W\d_]+")


class Traced:
    """A text with the way back to its source.

    Each pass replaces some spans; ``back`` maps a span of the result to the
    span of the source that it stands for.
    """

    def __init__(self, source: str):
        self.source = self.text = source
        self._passes: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [begin, end) by a string, for sorted spans that don't overlap."""
        if not edits:
            return
        parts, at, size = [], 0, 0
        marks: list[tuple[int, int, int, int]] = []  # begin and end in the result, begin and end before
        for begin, end, new in edits:
            parts.append(self.text[at:begin])
            size += begin - at
            parts.append(new)
            marks.append((size, size + len(new), begin, end))
            size += len(new)
            at = end
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self._passes.append(([m[0] for m in marks], marks))

    def substitute(self, pattern: re.Pattern, new) -> None:
        edits = [(m.start(), m.end(), new(m)) for m in pattern.finditer(self.text)]
        self.rewrite([e for e in edits if self.text[e[0] : e[1]] != e[2]])

    def back(self, begin: int, end: int) -> tuple[int, int]:
        for starts, marks in reversed(self._passes):
            begin, end = self._shift(starts, marks, begin, False), self._shift(starts, marks, end, True)
        return begin, end

    @staticmethod
    def _shift(starts: list[int], marks: list[tuple[int, int, int, int]], pos: int, is_end: bool) -> int:
        k = bisect_right(starts, pos if not is_end else pos - 1) - 1
        if k < 0:
            return pos
        new_begin, new_end, old_begin, old_end = marks[k]
        if pos < new_end or (is_end and pos == new_end):
            if pos == new_begin and not is_end:
                return old_begin
            return old_end if is_end else old_begin
        return old_end + (pos - new_end)


# fixed values: characters without a look of their own, and look-alikes
_INVISIBLE = re.compile("[\xad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe0f]+")
_FOLD = re.compile("[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000\u2010-\u2015\u2212\u2018\u2019\u02bc\xb4\u2032\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9\u0966-\u096f]")
_FOLD_MORE = re.compile("[\U0001d400-\U0001d7ff①-⑳Ⓐ-ⓩ]")
_ODD = re.compile(f"[{_INVISIBLE.pattern[1:-2]}{_FOLD.pattern[1:-1]}{_FOLD_MORE.pattern[1:-1]}]")
_HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοντρικυΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aeopcyxijshdqwABEKMHOPCTYXIJSaovtpikuABEHIKMNOPTYXZ"))
_SEAM = re.compile("[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
# fixed values: the digits as words
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9", "ноль": "0", "один": "1", "два": "2", "три": "3", "четыре": "4", "пять": "5", "шесть": "6",
    "семь": "7", "восемь": "8", "девять": "9", "ნული": "0", "ერთი": "1", "ორი": "2", "სამი": "3", "ოთხი": "4", "ხუთი": "5", "ექვსი": "6",
    "შვიდი": "7", "რვა": "8", "ცხრა": "9",
}
_TIMES = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
_ONE = "(?:(?:double|triple|doble|doppel)[ -]?)?(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|плюс|más)[ ]+)?(?:{_ONE}|\d)(?:[ ,.\-]{{1,2}}(?:{_ONE}|\d+)){{6,}}(?!\w)")
_DIGIT_TOKENS = frozenset(_DIGIT_WORDS) | {"plus", "плюс", "más"} | {n + w for n in _TIMES for w in _DIGIT_WORDS}
_DIGIT_NEXT = re.compile(rf"[ ,.\-]+(?:{_ONE}|\d)")
_DIGIT_LAST = re.compile(r"\d[ ,.\-]{1,2}(?:(?:double|triple|doble|doppel)[ -]?)?$")
_DIGIT_PART = re.compile(rf"(?i){_ONE}|\d+|plus|плюс|más")
# fixed values: words for the signs of an address
_AT = r"(?:\s*[\[({<]\s*(?:at|@|ät|arroba|собака)\s*[\])}>]\s*|\s+(?:at|@|ät|arroba|sobaka|собака|klammeraffe)\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|точка|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|точка|tochka)\s+|\.)"
_PARTS = 126  # dots a mail address can have: a name of the net has 127 labels at most
_DISGUISED = re.compile(rf"(?i)(?<![\w.+'-])(?P<user>[\w+'-]++(?:{_DOT}[\w+'-]++){{0,{_PARTS}}})(?P<at>{_AT})(?P<host>[\w-]++(?:{_DOT}[\w-]++){{1,{_PARTS}}})(?![\w-])")
_SIGN_WORDS = frozenset("dot punkt punto точка tochka arroba собака sobaka klammeraffe ät".split())
_LOOSE_AT = re.compile(r"\s@|@\s|[\[({<]@|@[\])}>]")
_BRACKET_AT = re.compile(r"(?i)[\[({<]\s*at\s*[\])}>]")
_BRACKET_DOT = re.compile(r"[\[({<]\s*\.\s*[\])}>]")
_HOST_AT = re.compile(r"(?i)\sat\s+[\w-]+\.[\w-]")
_DOT_ANY = re.compile(rf"(?i){_DOT}")
# fixed values: words of a sentence, that no spoken address begins or ends with beside the "at"
_STOP = frozenset(
    "a an the on in of to at is it and or for my our your his her their this that we you they i be as by from near with dot der die das den dem ein eine im am "
    "auf und oder el la los las un una en de y o и в на у с по не это".split()
)
# fixed values: generic top-level domains; those of countries have two letters
_GENERIC = frozenset("com org net info biz edu gov int mil name pro app dev test example invalid".split())


def _plain_char(m: re.Match) -> str:
    c = m.group()
    if c in "\u2018\u2019\u02bc\xb4\u2032\uff07":
        return "'"
    if c.isspace() or "\u2010" <= c <= "\u2015" or c == "\u2212":
        return " " if c.isspace() else "-"
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and not folded.isdecimal():
        return folded
    digit = unicodedata.decimal(c, None)
    return str(digit) if digit is not None else (folded if len(folded) == 1 else c)


def _spelled(low: str, found: set[str]) -> bool:
    """Whether one of the digit words found stands beside another digit, as any in a spelled number does."""
    for word in found:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if _DIGIT_NEXT.match(low, end) or _DIGIT_LAST.search(low, max(0, at - 16), at):
                return True
            at = low.find(word, end)
    return False


def _digits_of(m: re.Match) -> str:
    if not _LETTERS.search(m.group()):
        return m.group()  # nothing spelled
    out = []
    for part in _DIGIT_PART.finditer(m.group()):
        word = part.group().lower()
        if word in ("plus", "плюс", "más"):
            out.append("+")
            continue
        if word.isdigit():
            out.append(word)
            continue
        times = 1
        for name, n in _TIMES.items():
            if word.startswith(name):
                times, word = n, word[len(name) :].strip(" -")
        out.append(_DIGIT_WORDS[word] * times)
    return "".join(out)


def _plain_mail(m: re.Match, known) -> str:
    user, host = _DOT_ANY.sub(".", m["user"]), _DOT_ANY.sub(".", m["host"])
    mine, labels = user.lower().split("."), host.lower().split(".")
    top, sign = labels[-1], m["at"].strip().lower()
    if not top.isalpha() or len(top) < 2:
        return m.group()
    if sign[0] not in "[({<":
        if (len(mine) == 1 and mine[0] in _STOP) or (len(labels) == 2 and labels[0] in _STOP):
            return m.group()
        plain_host = host == m["host"]
        if plain_host and host[0].islower() and top != host.rsplit(".", 1)[1]:
            return m.group()  # "at the mill.So we" is the end of a sentence
        if sign != "@":
            if top not in _GENERIC and (len(top) > 2 or all(x in _STOP or known(x) for x in (*mine, *labels[:-1]))):
                return m.group()
            if sign == "at" and plain_host and user == m["user"] and known(user.lower()):
                return m.group()  # only "at" is spelled: "photos at example.org" is no address
    return f"{user}@{host}"


def normalise(text: str, known=lambda word: False) -> tuple[Traced, set[str]]:
    """The text in plain characters, digits and signs, with the way back, and its words in small letters.

    ``known``: whether a word is an ordinary one, that no mailbox is named by.
    """
    t = Traced(text)
    if not text.isascii():
        if _ODD.search(t.text):
            t.substitute(_INVISIBLE, lambda m: "")
            t.substitute(_FOLD, _plain_char)
            t.substitute(_FOLD_MORE, _plain_char)
        if _SEAM.search(t.text):
            t.substitute(_LETTERS, lambda m: "".join(_HOMOGLYPHS.get(c, c) for c in m.group()) if _SEAM.search(m.group()) else m.group())
    # these tell which transducers have nothing to do, and never more than that
    low = t.text.lower()
    tokens = set(_LETTERS.findall(low))
    plain = t.text
    if _spelled(low, tokens & _DIGIT_TOKENS):
        t.substitute(_SPELLED, _digits_of)
    has_at = "@" in t.text
    if (
        not tokens.isdisjoint(_SIGN_WORDS)
        or (has_at and _LOOSE_AT.search(t.text))
        or ("at" in tokens and (_BRACKET_AT.search(t.text) or _HOST_AT.search(t.text)))
        or ((has_at or "at" in tokens) and _BRACKET_DOT.search(t.text))
    ):
        t.substitute(_DISGUISED, lambda m: _plain_mail(m, known))
    return t, tokens if t.text is plain else set(_LETTERS.findall(t.text.lower()))


# ---------------------------------------------------------------- identifiers

_MAIL = re.compile(r"(?<![\w.+'%@-])\w[\w.+'%-]*+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}(?![\w@])")
_RUN = re.compile(r"(?<![\w+@#])(?:\+ ?|\(\+?)?\d(?:[ ().\-/]{0,3}\d){6,16}(?![\d@])")
_RUN_HINT = re.compile(r"\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d[ ().\-/]{0,3}\d")
# fixed values: words before numbers of people, and before numbers of things
_ID_LABEL = re.compile(
    r"(?i)(?:паспорт\w*|ausweis\w*|(?<![^\W\d_])(?:passport|passeport|reisepass|pass|pasaporte|national id|id card|identity (?:card|number)|id number|personal (?:id|number)|person(?:al)?nummer|"
    r"personennummer|steuer-?id|sozialversicherungsnummer|ssn|social security(?: number)?|my social|social insurance(?: number)?|insurance number|national insurance|"
    r"dni|nif|nie|снилс|инн|личный номер|удостоверени\w+|номер паспорта|número (?:de identidad|personal)|documento|პირადი ნომერი|პასპორტი\w*))"
    r"[\s:#№.,=-]*(?:(?:number|no\.?|nr\.?|nº|is|ist|es|this|номер)[\s:#№.=-]*){0,2}$"
)
_THING_LABEL = re.compile(
    r"(?i)(?:(?<![^\W\d_])(?:order|orders|tracking|shipment|parcel|isbn|issn|ean|sku|meter|reading|invoice|version|ver|build|serial|s/n|seat|row|ticket|case|ref|reference|commit|"
    r"machine|unit|model|part|port|route|room)|zähler\w*|bestell\w*|sendung\w*|rechnung\w*|pedido|envío|factura|contador|lectura|seguimiento|заказ\w*|посылк\w*|трек\w*|"
    r"счётчик\w*|счет\w*|рейс|билет|номер заказа)[\s:#№.]*(?:(?:reading|number|no\.?|nr\.?|id|is|code|номер)[\s:#№.]*){0,2}$|[#=*]\s*$|\bv\.?\s*$"
)
_MATH_AFTER = re.compile(r"[ \t]*[/*=×÷][ \t]*\d")
_PASSPORT = re.compile(r"(?<![\w-])[A-Za-z]{1,2} ?\d{6,9}(?![\w-])")
_LONG = re.compile(r"\d{6}")
_DNI = re.compile(r"(?<![\w-])(?:\d{8}|[XYZxyz]-?\d{7})[ -]?[A-HJ-NP-TV-Za-hj-np-tv-z](?![\w])")
_DATE = re.compile(r"(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)\d\d(?!\d)")
_IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}$")
_NANP = re.compile(r"(?:\+?1[-. ]?)?(?:\([2-9]\d\d\)[ -]?|[2-9]\d\d[-. ])[2-9]\d\d[-. ]\d{4}$")
_NANP_PLAIN = re.compile(r"\+1[2-9]\d{9}$")
_NANP_BARE = re.compile(r"[2-9]\d\d[2-9]\d{6}$")


LABEL_REACH = 48  # characters: what ends further before a number isn't its label
STREET_REACH = 70  # characters: a street's kind and name that begin further before a number have another


def _before(text: str, at: int) -> str:
    """What stands before a number on its line, as far as labels reach."""
    low = max(0, at - LABEL_REACH)
    return text[max(low, text.rfind("\n", low, at) + 1) : at]


def _numbers(text: str, spelled: Callable[[int, int], bool]) -> Iterator[tuple[int, int, str]]:
    """Spans of phone and identity numbers. ``spelled``: whether a span stood in words in the source."""
    long = _LONG.search(text)
    for m in _DNI.finditer(text) if long else ():
        before = _before(text, m.start())
        letter_apart = text[m.end() - 2] in " -"
        upper = text[m.end() - 1].isupper()
        if _THING_LABEL.search(before):
            continue
        if _ID_LABEL.search(before) or (upper and (letter_apart or text[m.end() - 2].isdigit())):
            after = text[m.end() : m.end() + 2]
            if not letter_apart or not (after[:1] == " " and after[1:2].islower() and text[m.end() - 1] in "AI" and not _ID_LABEL.search(before)):
                yield m.start(), m.end(), "id_number"
    for m in _PASSPORT.finditer(text) if long else ():
        before = _before(text, m.start())
        if _ID_LABEL.search(before):
            yield m.start(), m.end(), "id_number"
        elif not _THING_LABEL.search(before) and re.fullmatch(r"[A-Z]{2} ?\d{7}", m.group()):
            yield m.start(), m.end(), "id_number"
    for m in _RUN.finditer(text):
        begin, end = m.span()
        run = m.group()
        if run.startswith("(") and ")" not in run:
            begin, run = begin + 1, run[1:]
        before, after = _before(text, begin), text[end : end + 12]
        digits = re.sub(r"\D", "", run)
        if _ID_LABEL.search(before):
            yield begin, end, "id_number"
            continue
        if _THING_LABEL.search(before) or _MATH_AFTER.match(after) or _DATE.match(run) or _IPV4.match(run):
            continue
        groups = [len(g) for g in re.findall(r"\d+", run)]
        n = len(digits)
        plus = run.startswith(("+", "(+"))
        if groups == [3, 2, 4] and not plus:
            yield begin, end, "id_number"
        elif groups == [3, 3, 3, 2] and not plus and not run.startswith("0") or groups == [3, 3, 3, 2] and re.fullmatch(r"\d{3}-\d{3}-\d{3}[ -]\d\d", run):
            yield begin, end, "id_number"
        elif plus and 8 <= n <= 15:
            yield begin, end, "phone"
        elif digits.startswith("00") and 11 < n <= 17:
            yield begin, end, "phone"
        elif n == 11 and len(groups) == 1 and not re.match(r"0[1-9]|8", digits):
            continue
        elif _NANP.match(run) or _NANP_PLAIN.match(run) or (_NANP_BARE.match(run) and spelled(begin, end)):
            yield begin, end, "phone"
        elif re.match(r"\(?0[1-9]", run) and 9 <= n <= 12 and (len(groups) > 1 or n in (10, 11)):
            if not (len(groups) == 3 and groups[-1] == 4 and groups[:2] in ([2, 2], [1, 2])):
                yield begin, end, "phone"
        elif re.fullmatch(r"8[ (-]{1,2}\d{3}\)?[ -]\d{3}[ -]?\d\d[ -]?\d\d", run):
            yield begin, end, "phone"


# ---------------------------------------------------------------- addresses

_ANY_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?<![\w.,:€$£#/@-])\d{1,4}(?:[A-Za-z](?![\w])|[кК/-]\d{1,3})?(?![\w:€$£%])")
# fixed values: kinds of street
_EN_TYPES = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|crescent|cres|terrace|ter|court|ct|place|pl|way|boulevard|blvd|square|sq|gardens|grove|mews|row|hill|parade|highway|hwy|alley|walk|quay|rise|view|park"
_EN_AHEAD = re.compile(rf"(?i)\d{{1,4}}[a-z]?,? +(?P<name>[^\W\d_][\w'.-]*(?: +[^\W\d_][\w'.-]*){{0,2}}) +(?P<type>{_EN_TYPES})\b\.?")
_EN_BEHIND = re.compile(rf"(?i)(?P<name>[^\W\d_][\w'-]*(?: [^\W\d_][\w'-]*)?) (?P<type>{_EN_TYPES})\.?,? *$")
_DE_BEHIND = re.compile(r"(?i)(?P<name>[^\W\d_][\w-]{2,}(?:straße|strasse|str\.?|weg|gasse|platz|allee|ring|ufer|damm|chaussee|steig|stieg|markt|graben|pfad|promenade|kamp|winkel)|(?:[^\W\d_][\w-]+ )(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|ring)|(?:am|an der|auf der|im|zum|zur|unter den) [^\W\d_][\w-]+(?: [^\W\d_][\w-]+)?),? *(?:nr\.? *)?$")
_ES_BEHIND = re.compile(r"(?i)(?<![\w])(?P<type>(?:calle|avda|avenida|plaza|pza|paseo|pº|camino|ronda|travesía|carretera|ctra|callejón|glorieta|rambla|vía)(?= )|(?:c|cl|avda|av|pza|ctra)\.|c/) *(?P<name>(?:(?:de|del|la|el|las|los|y) )*[^\W\d_][\w'.-]*(?: [^\W\d_][\w'.-]*){0,4}?) *,? *(?:n[º°.]\.?º?|núm\.?|número|no\.)? *$")
_RU_BEHIND = re.compile(r"(?i)(?<!\w)(?:(?:(?:ул|пр|просп|пер|наб|пл|бул)\. *|(?:ул|улиц[аеу]|проспект\w?|пр-т|переул\w+|набережн\w+|шоссе|бульвар\w?|б-р|площад\w+|проезд\w?|алле[яюие]|тупик|линия) +)[^\W\d_][\w.-]*(?: [^\W\d_][\w.-]*){0,2}|[^\W\d_][\w-]+ (?:улица|улице|ул\.?|проспект\w?|пр-т|переулок|пер\.?|набережная|наб\.?|шоссе|бульвар|б-р|площадь|проезд|аллея)),? *(?:(?:д\.?|дом|№) *)?$")
_KA_BEHIND = re.compile(r"(?:[ა-ჰ]+(?:ის|ს)? )(?:ქუჩა|ქ\.|გამზირი|გამზ\.|მოედანი|ხეივანი)[ა-ჰ]*,? *(?:[N№] *)?$")
_NOT_STREET = frozenset(
    "a an the on in of to at is it and or for my our your his her their this that these those we you they i be been was were are as by from near with after before until since per each "
    "every any some no not more most other than then but so if up down out off over under again about around good main food seats chairs tables people floors floor minutes hours days "
    "weeks months years euros euro lari cents dollars percent times of between second third first last next".split()
)


# each pattern needs one of these words, or a word with one of these ends, before the number
_EN_WORDS = frozenset(_EN_TYPES.split("|"))
_ES_WORDS = frozenset("calle c cl avda avenida av plaza pza paseo pº p camino ronda travesía carretera ctra callejón glorieta rambla vía".split())
_RU_WORDS = frozenset("ул пр просп пер наб пл бул б".split())
_RU_STEMS = ("улиц", "проспект", "переул", "набережн", "шоссе", "бульвар", "площад", "проезд", "алле", "тупик", "линия")
_DE_WORDS = frozenset("str straße strasse platz allee ring ufer damm am an auf im zum zur unter weg gasse".split())
_DE_ENDS = (
    "straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "chaussee", "steig", "stieg", "markt", "graben", "pfad",
    "promenade", "kamp", "winkel",
)
_DE_ENDS += tuple(end + "nr" for end in _DE_ENDS)  # the number's sign may follow without a space
_KA_WORDS = ("ქუჩა", "ქ", "გამზირი", "გამზ", "მოედანი", "ხეივანი")
_STEMS = (*_RU_STEMS, *_KA_WORDS)
_ANY_STREET = _EN_WORDS | _ES_WORDS | _RU_WORDS | _DE_WORDS


def street_words(tokens: set[str]) -> list[str]:
    """The words of a text that a street may be recognised by."""
    return [t for t in tokens if t in _ANY_STREET or t.endswith(_DE_ENDS) or t.startswith(_STEMS)]


def _patterns(words: list[str]) -> Iterator[re.Pattern]:
    if not _RU_WORDS.isdisjoint(words) or any(w.startswith(_RU_STEMS) for w in words):
        yield _RU_BEHIND
    if not _ES_WORDS.isdisjoint(words):
        yield _ES_BEHIND
    if not _DE_WORDS.isdisjoint(words) or any(w.endswith(_DE_ENDS) for w in words):
        yield _DE_BEHIND
    if not _EN_WORDS.isdisjoint(words[-1:]):
        yield _EN_BEHIND
    if any(w.startswith(_KA_WORDS) for w in words[-2:]):
        yield _KA_BEHIND


def _addresses(text: str, ordinary, streets: list[str]) -> Iterator[tuple[int, int]]:
    base, wanted = 0, frozenset(streets)
    for line in text.split("\n"):
        low = line.lower()
        if (len(wanted) > FEW or any(w in low for w in wanted)) and _ANY_DIGIT.search(line) and not wanted.isdisjoint(_LETTERS.findall(low)):
            for begin, end in _addresses_of_line(line, ordinary):
                yield base + begin, base + end
        base += len(line) + 1


def _addresses_of_line(text: str, ordinary) -> Iterator[tuple[int, int]]:
    ahead = not _EN_WORDS.isdisjoint(_LETTERS.findall(text.lower()))
    for m in _NUMBER.finditer(text):
        begin, end = m.span()
        a = _EN_AHEAD.match(text, begin) if ahead else None
        if a:
            words = re.findall(r"[^\W\d_][\w'-]*", a["name"])
            low = [w.lower().strip(".") for w in words]
            capital = all(w[0].isupper() for w in words) or text[begin : a.end()].isupper()
            if not any(w in _NOT_STREET for w in low) and (capital or not ordinary(low[0])):
                yield begin, a.end()
                continue
        tail = text[max(0, begin - STREET_REACH) : begin]
        if len(tail) < 4 or not (tail[-1] in " ,.№º°" or tail[-1].isalpha()):
            continue
        words_before = _LETTERS.findall(tail.lower())
        if not words_before:
            continue
        offset = begin - len(tail)
        if re.match(r"\s*(?:€|\$|£|%|euros?\b|lari\b|cents?\b|минут|Minuten|minutos|minutes|of\b|x\b|am\b|pm\b)", text[end : end + 10]):
            continue
        for pattern in _patterns(words_before):
            b = pattern.search(tail)
            if not b:
                continue
            if pattern is _ES_BEHIND:
                words = [w for w in re.findall(r"[^\W\d_]+", b["name"].lower()) if w not in ("de", "del", "la", "el", "las", "los", "y")]
                if not words or len(b["name"]) > 45 or any(w in ("está", "es", "para", "por", "con", "que", "hasta", "a", "en", "cerca") for w in words):
                    continue
                if b["type"].lower() in ("c.", "cl.", "vía", "camino", "plaza", "ronda", "carretera") and not b["name"].split()[-1][0].isupper():
                    continue
            elif pattern is _DE_BEHIND:
                name = b["name"]
                last = name.split()[-1]
                if not (name[0].isupper() or last[0].isupper() or not ordinary(last.lower())) or ordinary(name.lower()):
                    continue
                if re.match(r"(?i)(?:am|an der|auf der|im|zum|zur|unter den) ", name) and not re.search(r"(?i)adresse|wohn\w*|straße", tail[: b.start()]):
                    continue
            elif pattern is _RU_BEHIND:
                words = [w for w in _LETTERS.findall(b.group()) if w.lower() not in _RU_WORDS and not w.lower().startswith(_RU_STEMS)]
                if all(w.islower() and (ordinary(w) or w in ("д", "дом")) for w in words):
                    continue
            elif pattern is _EN_BEHIND:
                words = b["name"].split()
                low = [w.lower() for w in words]
                if low[-1] in _NOT_STREET or not (words[-1][0].isupper() or not ordinary(low[-1])) or b["type"].lower() in ("row", "way", "park", "view", "hill", "walk", "rise"):
                    continue
            start = offset + b.start()
            if pattern is _EN_BEHIND and len(words) > 1 and words[0].islower() and words[-1][0].isupper():
                start += tail[b.start() :].index(words[-1])  # the word before the street's name
            yield start, end
            break


# ---------------------------------------------------------------- names

_INITIAL = re.compile(r"(?<![\w.])[A-ZÀ-ÞА-ЯЁ]\. ?[^\W\d_]{4,}")


def _names(text: str, lexicon: Lexicon, hits: set[str]) -> Iterator[tuple[int, int]]:
    """Spans of full names in a text whose labels and other finds are blanked out.

    ``hits``: the words of the text that are given or family names of the lexicon.
    """
    initials = bool(_INITIAL.search(text))
    pairs = [(a, b, first, last) for a, b, first, last in pairs_of(text) if lexicon.leads_to_name(text, a)]
    if not (hits or initials or pairs):
        return
    base = at = 0
    for line in text.split("\n"):
        mine = at
        while at < len(pairs) and pairs[at][0] <= base + len(line):
            at += 1
        if (hits and _holds_name(line, lexicon, hits)) or (initials and _INITIAL.search(line)):
            yield from _names_of_line(line, base, lexicon)
        for begin, end, first, last in pairs[mine:at]:
            if lexicon.ordinary(first.lower()) or not lexicon.family_like(last) or not (first.lower() in lexicon.given or lexicon.family_like(first)):
                continue
            more = TITLE.match(text, end + 1) if text[end : end + 1] == " " else None  # a second family name
            yield begin, more.end() if more and lexicon.family_like(more.group()) else end
        base += len(line) + 1


def _holds_name(line: str, lexicon: Lexicon, hits: set[str]) -> bool:
    """Whether a line has a name of the lexicon; one that is an ordinary word as well needs a capital, or a word made like a family name beside it."""
    if len(hits) <= FEW:  # the same by a quicker way
        low_line = line.lower()
        if not any(h in low_line for h in hits):
            return False
    words = _LETTERS.findall(line)
    weak = False
    for word in words:
        low = word.lower()
        if low in hits:
            if low not in lexicon.words or (word[0].isupper() and (word.isupper() or word[1:].islower())):
                return True
            weak = True
    return weak and any(lexicon.compound(w.lower()) for w in words)


def _names_of_line(line: str, base: int, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(line)]

    def glued(i: int) -> bool:
        """Part of an address, a handle or a file name."""
        t, a, b = tokens[i]
        return (a > 0 and line[a - 1] in "@_/\\+") or (a > 1 and line[a - 1] == "." and line[a - 2].isalnum()) or (b < len(line) and (line[b] in "@_\\" or line[b].isdigit() or (line[b] == "." and b + 1 < len(line) and line[b + 1].isalnum() and b - a > 1)))

    def same_case(x: str, y: str) -> bool:
        x, y = x.removesuffix("'s"), y.removesuffix("'s")
        return x.isupper() == y.isupper() and x[0].isupper() == y[0].isupper() or (len(x) == 1 and y[0].isupper())

    found = -1
    # where a name can begin: at a given name or an initial, or just before one
    lead = [len(t) == 1 or t.lower().removesuffix("'s") in lexicon.given for t, _, _ in tokens]
    for i, (t, a, b) in enumerate(tokens):
        if not (lead[i] or (i + 1 < len(lead) and lead[i + 1])) or a < found or glued(i):
            continue
        is_given = t.lower() in lexicon.given
        is_initial = len(t) == 1 and b < len(line) and line[b] == "."
        if is_given or is_initial:
            # given [initial] family
            j = i + 1
            gap_from = b + (1 if is_initial else 0)
            if is_given and j + 1 < len(tokens) and len(tokens[j][0]) == 1 and line[gap_from : tokens[j][1]].isspace():
                dot = tokens[j][2] + (1 if line[tokens[j][2] : tokens[j][2] + 1] == "." else 0)
                if dot > tokens[j][2] and line[dot : tokens[j + 1][1]].strip() == "" and same_case(t, tokens[j + 1][0]) and lexicon.family_like(tokens[j + 1][0]) and not glued(j + 1):
                    yield base + a, base + tokens[j + 1][2]
                    found = tokens[j + 1][2]
                    continue
            if j < len(tokens):
                f, fa, fb = tokens[j]
                gap = line[gap_from:fa]
                if (gap.isspace() or (is_initial and gap == "")) and not glued(j) and same_case(t, f):
                    good = lexicon.family_like(f)
                    if is_initial:
                        good = good and (f[0].isupper() or lexicon.known_family(f.lower())) and f.lower() not in lexicon.given
                    if good:
                        end = fb
                        # a second family name
                        if j + 1 < len(tokens) and line[fb : tokens[j + 1][1]].isspace() and tokens[j + 1][0][0].isupper() and same_case(f, tokens[j + 1][0]) and lexicon.family_like(tokens[j + 1][0]):
                            end = tokens[j + 1][2]
                        yield base + a, base + end
                        found = end
                        continue
        # family [,] given or initial
        if i + 1 < len(tokens) and not is_given and len(t) > 3:
            g, ga, gb = tokens[i + 1]
            gap = line[b:ga]
            given_next = g[:-2].lower() in lexicon.given if g.endswith("'s") else g.lower() in lexicon.given
            initial_next = len(g) == 1 and g.isupper() and line[gb : gb + 1] == "." and lexicon.known_family(t.lower())
            if (given_next or initial_next) and not glued(i + 1) and (gap.isspace() or (gap.startswith(",") and gap[1:].isspace())):
                sure = lexicon.known_family(t.lower()) or all(lexicon.known_family(p.lower()) for p in t.split("-"))
                if (sure and same_case(t, g)) or (t[0].isupper() and g[0].isupper() and not t.isupper() and not g.isupper() and i > 0 and lexicon.family_like(t)) or (
                    t[0].isupper() and g[0].isupper() and not t.isupper() and i == 0 and gap.startswith(",") and lexicon.family_like(t)
                ) or (t[0].isupper() and g[0].isupper() and not t.isupper() and i == 0 and len(tokens) == 2 and lexicon.family_like(t)):
                    yield base + a, base + gb
                    found = gb


# ---------------------------------------------------------------- the whole


FEW = 8  # words that are looked for one by one before a line is cut into its words


class _Spans:
    """Spans without overlaps, in order of their place: of two that overlap, the first to come stays."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, str]] = []

    def add(self, begin: int, end: int, kind: str) -> None:
        i = bisect_right(self.items, (begin, end, kind))
        if (i and self.items[i - 1][1] > begin) or (i < len(self.items) and self.items[i][0] < end):
            return
        self.items.insert(i, (begin, end, kind))

    def blank(self, text: str) -> str:
        """The text with the spans blanked out; line breaks stay."""
        parts, at = [], 0
        for begin, end, _ in self.items:
            parts += [text[at:begin], _NOT_BREAK.sub("\x01", text[begin:end])]
            at = end
        return "".join([*parts, text[at:]])


_NOT_BREAK = re.compile("[^\n]")


def _but_names(text: str, lexicon: Lexicon) -> tuple[Traced, set[str], _Spans, str]:
    """A text as it is read, its tokens, what is found in it but names, and the text without that."""
    # labels keep their place but not their letters
    source = LABEL.sub(lambda m: "\x01" * len(m.group()), text) if "[" in text else text
    t, tokens = normalise(source, lexicon.no_mailbox)
    spans = _Spans()
    clear = t.text
    if "@" in clear:
        for m in _MAIL.finditer(clear):
            spans.add(*m.span(), "email")
        clear = spans.blank(clear) if spans.items else clear
    if _RUN_HINT.search(clear) or _LONG.search(clear):
        for found in _numbers(clear, lambda a, b: bool(_LETTERS.search(text[slice(*t.back(a, b))]))):
            spans.add(*found)
        clear = spans.blank(clear) if spans.items else clear
    streets = street_words(tokens) if _ANY_DIGIT.search(clear) else []
    if streets:
        for begin, end in _addresses(clear, lexicon.ordinary, streets):
            spans.add(begin, end, "address")
        clear = spans.blank(clear) if spans.items else clear
    return t, tokens, spans, clear


def find(text: str | None, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the personal information in a text, in source offsets, without overlaps."""
    if not text:
        return []
    t, tokens, spans, clear = _but_names(text, lexicon)
    for begin, end in _names(clear, lexicon, tokens & lexicon.names):
        spans.add(begin, end - 2 * clear.endswith("'s", begin, end), "name")  # the ending stays with the text
    return sorted((*t.back(a, b), kind) for a, b, kind in spans.items)


def redact(text: str | None, lexicon: Lexicon) -> str | None:
    """The text with each find replaced by its placeholder, such as ``[EMAIL]``."""
    if not text:
        return text
    out, at = [], 0
    for begin, end, kind in find(text, lexicon):
        if begin < at:
            continue
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    out.append(text[at:])
    return "".join(out)


# ---------------------------------------------------------------- over tables


def _words_of(text: str, pattern=re.compile(r"[^\W\d_]+")) -> set[str]:
    """What of a text can be looked up as a name: its words as they are read, and those joined by hyphen or apostrophe."""
    clear = normalise(LABEL.sub("", text) if "[" in text else text)[0].text
    words = {w.lower() for w in TOKEN.findall(clear)}
    return words | {w.removesuffix("'s") for w in words} | {w.lower() for w in pattern.findall(clear)}


def _contexts_of(text: str, lexicon: Lexicon) -> set[str]:
    """The contexts of a text's capitalised pairs."""
    if not text:
        return set()
    clear = _but_names(text, lexicon)[3]
    return {c for at, *_ in pairs_of(clear) for c in contexts_before(clear, at)}


MODEL = ("__known", "__led")  # columns with the names and the contexts that a row's text has


def _with_lexicon(texts: DataFrame, names: Names, text_col: str, pack: Callable[[pa.RecordBatch, pa.Array, Iterator[Lexicon]], pa.RecordBatch], schema: str) -> DataFrame:
    """``texts`` through ``pack``, which gets a batch, its texts, and the lexicon of each of them.

    A lexicon that is small enough goes to every worker. Beyond that, the words
    of each row meet the names in a join, and a row brings along the few it holds;
    so do the contexts of its capitalised pairs.
    """
    share = texts.sparkSession.sparkContext.broadcast(names.lexicon)
    at = texts.columns.index(text_col)
    if names.table is None and names.contexts is None:

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pack(batch, batch.column(at), repeat(share.value))

        return texts.mapInArrow(fn, schema)
    rows = cut_lineage(texts.withColumn("__row", F.monotonically_increasing_id()))

    def looked_up(rows: DataFrame, keys: Callable[[str, Lexicon], set[str]], table: DataFrame, out: str) -> DataFrame:
        """``rows`` with ``out``: the rows of ``table`` (key, ...) whose keys a row's text has."""

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted(keys(t.as_py() or "", lexicon)) for t, lexicon in zip(batch.column(1), lexicons(batch))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["__row", "keys"])

        asked = rows.select("__row", text_col, *[c for c in MODEL if c in rows.columns]).mapInArrow(held, "__row bigint, keys array<string>")
        met = asked.select("__row", F.explode("keys").alias("key")).join(table, "key").groupBy("__row").agg(F.collect_list(F.struct(*table.columns)).alias(out))
        return rows.join(met, "__row", "left")

    by_words, by_contexts = names.table is not None, names.contexts is not None

    def lexicons(batch: pa.RecordBatch) -> Iterator[Lexicon]:
        known, led = ([None] * batch.num_rows if c not in batch.schema.names else batch.column(batch.schema.names.index(c)).to_pylist() for c in MODEL)
        for words, contexts in zip(known, led):
            lexicon = share.value.among([(w["key"], w["given"], w["family"]) for w in words or ()]) if by_words else share.value
            yield lexicon.in_contexts([c["key"] for c in contexts or ()]) if by_contexts else lexicon

    if by_words:
        rows = looked_up(rows, lambda text, _: _words_of(text), names.table.withColumnRenamed("word", "key"), MODEL[0])
    if by_contexts:
        rows = looked_up(rows, _contexts_of, names.contexts, MODEL[1])
    joined = rows.select(*texts.columns, *[c for c in MODEL if c in rows.columns])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - by_words - by_contexts
            plain = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
            yield pack(plain, batch.column(at), lexicons(batch))

    return joined.mapInArrow(by_row, schema)


def personal_information(texts: DataFrame, names: Names, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, kind, begin, end): every find, 0-based, in code points of the source text.

    Null and blank texts have no finds. Rows of equal ids are searched each.
    """

    def pack(batch: pa.RecordBatch, column: pa.Array, lexicons: Iterator[Lexicon]) -> pa.RecordBatch:
        rows, begins, ends, kinds = [], [], [], []
        for i, (t, lexicon) in enumerate(zip(column, lexicons)):
            for begin, end, kind in find(t.as_py(), lexicon):
                rows.append(i)
                kinds.append(kind)
                begins.append(begin)
                ends.append(end)
        ids = batch.column(0).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=[id_col, "kind", "begin", "end"])

    return _with_lexicon(texts.select(id_col, text_col), names, text_col, pack, f"`{id_col}` {dict(texts.dtypes)[id_col]}, kind string, begin bigint, end bigint")


def redacted(texts: DataFrame, names: Names, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """``texts`` with ``out_col``: the text with placeholders. A column of that name is replaced; null stays null."""
    texts = texts.drop(out_col)

    def pack(batch: pa.RecordBatch, column: pa.Array, lexicons: Iterator[Lexicon]) -> pa.RecordBatch:
        out = [redact(t.as_py(), lexicon) for t, lexicon in zip(column, lexicons)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return _with_lexicon(texts, names, text_col, pack, f"{fields}, `{out_col}` string")
