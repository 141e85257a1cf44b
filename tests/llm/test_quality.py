import base64
import random
import time

import pytest

from chatloom.llm.quality import markup_length, shape_of, statistics, text_quality

COMMON = set("the a and to of is in it we that for on at was not this with но и в не на".split())
rng = random.Random(1)

PROSE = [
    "We met at the mill and it was fine. Nobody knew who had the key, so we waited.", "so we met at the mill and it was fine nobody knew who had the key so we waited for an hour", "[2024-01-02 10:11] Ann: hi\n[2024-01-02 10:12] Bo: ok",
    "Ann: hi\nBo: what is it?\nAnn: the key is on the table", "Ann, 10:11\nhi there\n\nBo, 10:12\nok", "> # Notes\n>\n> We talked about the boat and it is still on the lake.", "Half the class counted\nthe boxes in the hall and\nwent home before it was dark",
    "The plan is simple. We need a few things for the trip to the lake, and then we go.\n\n- tent\n- pot\n\nAfter that it was late, and the others were not there in time.", "hi", "12 people came.", "Мы встретились на мельнице, и всё было в порядке.",
]
LISTS = ["TODO\n- tent\n- 3 x pot\n- rope (Ann)\n- https://example.org/x", "1) tent\n2) pot\n  3) rope", "tent\nold pot\n5 x rope\nblue lamp", "[ ] tent\n[x] pot\n[ ] rope", "We met at the mill.\n• tent\n• pot\n• rope\n• lamp\n• saw\n• mug", "\ttent\n\tpot\n\trope (Bo)"]
TABLES = ["a,b,c\n1,2,3\n4,5,6\n7,8,9", "| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |\n| z | 3 |", "name\tkg\nrope\t1\npot\t2\nlamp\t3", "thing      price     who\nrope       1.20      Ann\npot        3.40      Bo\nlamp       5.60      Cy", "# Costs\nitem;kg;ok\nrope;1;yes\npot;2;\nlamp;3;no"]
JUNK = [
    "free " * 60, "CLICK HERE " * 40, "$$$$$$ ####### !!!!!!!\n@@@@@ ~~~~~~", "🙂🙂🙂🙂 🎉🎉🎉 ✅✅✅✅✅", base64.b64encode(rng.randbytes(400)).decode(), " ".join(f"{rng.randrange(256):02x}" for _ in range(200)),
    "\n".join(f"00:42:{i:02d}.473 WARN w-9 req=12f{i}84 dt=30ms st=404" for i in range(20)), '<div class="c1"><span id=3></span>&nbsp;</div>{{x}}\n' * 8, "asdf jkl;lkj qwe poiu\nsdfg hjk\nqwepoiu asdfgh\nlkjh zxc", "Ð”ÐµÐ½ÑŒÐ³Ð¸ Ñ\x81Ð¾Ð±Ñ€Ð°Ð½Ñ‹ " * 4,
]


@pytest.mark.parametrize(("text", "shape"), [(t, k) for k, ts in (("prose", PROSE), ("list", LISTS), ("table", TABLES), ("junk", JUNK)) for t in ts])
def test_shapes(text, shape):
    assert shape_of(statistics(text, COMMON)) == shape


@pytest.mark.parametrize("text", [None, "", "  　\n\t", "​ ﻿"])
def test_blank_is_no_case(text):
    s = statistics(text, COMMON)
    assert shape_of(s) is None and s["word_count"] == 0


def test_numbers():
    s = statistics("The cat sat.\nThe cat sat.\n\nOn it, we", COMMON)
    assert s["word_count"] == 9 and s["n_lines"] == 3 and s["mean_word_length"] == pytest.approx(24 / 9)
    assert s["end_punct_share"] == pytest.approx(2 / 3) and s["common_word_share"] == pytest.approx(5 / 9)
    assert s["symbol_ratio"] == pytest.approx(3 / 27) and s["dup_line_share"] == pytest.approx(1 / 3)


def test_tables(spark):
    docs = spark.createDataFrame([(1, PROSE[0], 5, "k"), (1, PROSE[0], 5, "k"), (2, None, 5, "k"), (None, "x" * 200_000, 5, "k")], "doc_id bigint, text string, n_chars int, shape string")
    words = spark.createDataFrame([("The", "en"), (None, "en")], "word string, lang string")
    got = text_quality(docs, words).collect()
    assert sorted((r.doc_id or 0, r.shape or "") for r in got) == [(0, "junk"), (1, "prose"), (1, "prose"), (2, "")] and len(got) == 4
    assert text_quality(docs.where("false"), words).collect() == []


LINE = "every friend of the lake gets one new boat for free today"
REPEATED = [
    f"{LINE}\n" * 200, f"{LINE}. " * 200, f"{LINE} " * 200, f"{LINE}\n\n" * 200, "".join(f"Ann: {LINE}\n" for _ in range(200)), "".join(f"[2024-01-02 10:{i % 60:02d}] Ann: {LINE}\n" for i in range(200)),
    f"We met there.\n{LINE}\nNobody knew who had the key. It was late.\n" * 60, "Bot: click here\n" * 40, f"Hello. {LINE}, a, 5\n" * 200,
]
NAMES = ["Ann", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"]
TEMPLATED = [
    " ".join(f"On day {i} {NAMES[i % 8]} went to the mill with {NAMES[i * 3 % 7]} and it was closed for want of {a}." for i, a in enumerate("rope pots lamps saws mugs tents boats keys chairs tables forks".split())),
    "\n".join(f"[2024-01-02 10:{i:02d}] {NAMES[i % 8]}: the key to room {i} is on the table of {NAMES[i * 5 % 8]}" for i in range(40)), "\n".join(f"{NAMES[i % 8]}: ok" for i in range(14)),
]


@pytest.mark.parametrize("text", REPEATED)
def test_endless_repetition_of_long_units_is_junk(text):
    assert shape_of(statistics(text, COMMON)) == "junk"


@pytest.mark.parametrize("text", TEMPLATED)
def test_templated_prose_is_prose(text):
    assert shape_of(statistics(text, COMMON)) == "prose"


def test_rows_of_few_kinds_are_a_table():
    rows = "".join(f"{('rope', 'pot', 'lamp')[i % 3]},{('yes', 'no')[i % 2]},{i % 4}\n" for i in range(300))
    assert shape_of(statistics("thing,ok,kg\n" + rows, COMMON)) == "table"


def test_keyboard_share_is_that_of_any_text():
    assert statistics("the tree was red", COMMON)["keyboard_share"] == pytest.approx(5 / 9)
    assert statistics("It was not for us", COMMON)["keyboard_share"] == pytest.approx(1 / 8)


BANNER = ["We use cookies to give you the best experience on our site and to show you offers.", "By clicking accept you agree to our use of cookies as set out in the policy of privacy."]
BOILERPLATE = [
    "\n".join(("Home | Offers | Contact us today for a quote", "All rights reserved by the owner of this site", "Subscribe to our letter for more news")[i % 3] for i in range(40)),
    "\n\n".join(BANNER * 2), "\n".join(f"{line}" for line in ("Skip to content and menu now", "Sign in or register here please", "Share this page with your friends") * 2),
]


@pytest.mark.parametrize("text", BOILERPLATE)
def test_copies_of_lines_and_paragraphs_are_boilerplate(text):
    assert shape_of(statistics(text, COMMON)) not in ("prose", None)


def test_a_refrain_is_no_boilerplate():
    song = "\n\n".join(f"{verse}\n\nand the river ran on to the sea" for verse in ("We met at the mill in the snow.", "Nobody knew who had the key.", "The boat was late and it was dark."))
    assert shape_of(statistics(song, COMMON)) == "prose"


def test_sentences_may_come_again():
    again = "If it does not come in time, we borrow one from the others.\n"
    text = again + "It is open who calls before tomorrow and says so.\n" + again * 3 + "It is open who calls before Monday and says so.\nWe met at the mill at noon.\n" + again
    assert shape_of(statistics(text, COMMON)) == "prose"


def test_markup_of_any_length():
    long_tag = f'<div style="{"x" * 5000}">'
    assert markup_length(long_tag) == len(long_tag) and markup_length(f"<!-- {long_tag} -->a") == len(long_tag) + 9
    assert markup_length("{{" + "y" * 999 + "}} b") == 1003 and markup_length("p.a { color: red; } c") == 19 and markup_length('{"a": 1}') == 0
    assert markup_length("a < b and c > d, x <y\n\nz> w") == 0


@pytest.mark.parametrize("unit", ["a", "A1", "<", "<!--", "{", "{a", "a{", "[b=", " ", "\n", "\n \n", "x (", ")", "aB", "a,", "> ", "é", "ab. "])
def test_a_megabyte_of_anything_takes_seconds(unit):
    began = time.process_time()
    assert statistics("x " + unit * (1_000_000 // len(unit)) + " <b x", COMMON)["n_chars"] > 900_000
    assert time.process_time() - began < 8


def test_short_texts_have_their_statistics():
    s = statistics("ha ha ha ha", COMMON)
    assert s["ngram_coverage"] == pytest.approx(1) and shape_of(s) == "prose"
    assert statistics("- " + "x" + " " * 60 + "y", COMMON)["item_line_share"] == 1
