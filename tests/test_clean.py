"""Planted texts for every cleaning rule, and the chain against a plain-Python rule table."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from labelspark.functions import clean as C


def run(spark, rule, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "rule, cases",
    [
        (
            C.fix_encoding,
            {
                "Å¡Å«das": "šūdas",
                "cafÃ©": "café",
                "café": "café",
                "šūdas": "šūdas",
                "plain": "plain",
                "â€œxâ€\x9d": "“x”",
                "cafÃ©\nžalia 日本": "café\nžalia 日本",
                "cafÃƒÂ©": "café",
                "cafÃƒÆ’Ã‚Â©\nÃ©": "café\né",
                "": "",
                None: None,
            },
        ),
        (
            C.compose,
            {
                "e\u0301 s\u030c z\u0307\u0323": "é š ẓ\u0307",
                "\u1112\u1161\u11ab": "한",
                "\u212b\u2126": "ÅΩ",
                "\u0958": "\u0915\u093c",
                "plain é 日本 \U0001f525": "plain é 日本 \U0001f525",
                "": "",
                None: None,
            },
        ),
        (
            C.remove_dates,
            {
                "on 2021-03-04 x": "on  x",
                "on 2021-03-04T10:30:00Z x": "on  x",
                "4.3.2021 x": " x",
                "3/4/21 x": " x",
                "5 March 2021 x": " x",
                "March 5th, 2021 x": " x",
                "Mar. 5 x": " x",
                "at 10:30 x": "at  x",
                "3.14 and 1234 and 10.0.12.34": "3.14 and 1234 and 10.0.12.34",
                "maybe 5 marching": "maybe 5 marching",
            },
        ),
        (C.remove_urls, {"a https://x.y/z?q b http://c": "a  b "}),
        (C.remove_mentions, {"hi @you: ok": "hi  ok"}),
        (C.remove_hashtags, {"so #tag1 it": "so  it"}),
        (C.remove_ips, {"at 999.1.22.333 now": "at  now", "1.2.3": "1.2.3"}),
        (C.remove_newline_token, {"aNEWLINE_TOKENb": "ab"}),
        (C.limit_punct_repeats, {"a!!!! b??? c,, d....": "a!! b?? c,, d.."}),
        (C.space_after_punct, {"a,b.c!!d": "a, b. c! ! d", "a, b": "a, b"}),
        (C.no_space_before_punct, {"a ,b \t!": "a,b!", "a! !": "a!!"}),
        (C.collapse_spaces, {"a  b\t\nc d  e": "a b c d e"}),
        (C.space_after_number, {"7kg 3.14 -7 7-8": "7 kg 3.14 -7 7-8"}),
        (C.space_before_number, {"kg7 -7 a77": "kg 7 -7 a 77"}),
        (
            C.demojize,
            {
                "a🔥b": "a ::fire:: b",
                "❤️": " ::red_heart:: ",
                "👍🏽": " ::thumbs_up_medium_skin_tone:: ",
                "👨‍👩‍👧!": " ::man_woman_girl:: !",
                "🇱🇹🇩🇪": " ::flag_LT::  ::flag_DE:: ",
                "1️⃣ ©™⌚▶": " ::keycap_1::   ::copyright::  ::trade_mark::  ::watch::  ::play_button:: ",
                "✓ ☐ 1 #": "✓ ☐ 1 #",
                "plain": "plain",
            },
        ),
        (C.strip_edges, {'"..text!?"': "text", " \t": "", "a.b": "a.b"}),
        (C.text_or_empty, {None: "", "x": "x"}),
        (
            C.repair_text,
            {
                "“a” ‘b’": "\"a\" 'b'",
                "Q&amp;A &eacute; &#65;&#x42; &nosuch; a&b": "Q&A é AB &nosuch; a&b",
                "<p>&amp;</p>": "<p>&amp;</p>",
                "ﬁne ﬄ Ａ１！　x": "fine ffl A1! x",
                "a\r\nb\rc\u2028d": "a\nb\nc\nd",
                "x\u0007y\ufeff\tz": "xy\tz",
                "cafÃ© &lt;": "café <",
                None: None,
            },
        ),
    ],
)
def test_rule(spark, rule, cases):
    assert run(spark, rule, list(cases)) == list(cases.values())


MARKS = ",.?!"


def plain_chain(text):
    """The punctuation and number rules, character by character."""
    text = "".join(text.split("NEWLINE_TOKEN"))
    out = ""
    for c in text:  # a mark follows at most one equal mark
        if not (c in MARKS and out[-2:] == c * 2):
            out += c
    spaced = ""
    for k, c in enumerate(out):
        spaced += c + (" " if c in MARKS and k + 1 < len(out) and not out[k + 1].isspace() else "")
    tight = ""
    for c in spaced:
        tight = (tight.rstrip() if c in MARKS else tight) + c
    single, gap = "", ""
    for c in tight + "x":  # two and more spaces are one blank
        if c.isspace():
            gap += c
            continue
        single, gap = single + (" " if len(gap) > 1 else gap) + c, ""
    single = single[:-1]
    digit = str.isdecimal
    after = ""
    for k, c in enumerate(single):
        following = single[k + 1 : k + 2]
        after += c + (" " if digit(c) and following and not following.isspace() and not digit(following) and following not in ",.?!-" else "")
    before = ""
    for k, c in enumerate(after):
        earlier = after[k - 1] if k else " "
        before += (" " if digit(c) and not earlier.isspace() and not digit(earlier) and earlier != "-" else "") + c
    return before.strip(string.punctuation + string.whitespace)


def test_chain_equals_a_character_loop(spark):
    pieces = ["a", "é", "7", "77", "-", ",", ".", "!", "?", " ", "\t", " ", " ", "٣", "\x85", "NEWLINE_TOKEN"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]

    def chain(c):
        for step in C.CLEAN_STEPS[C.CLEAN_STEPS.index(C.remove_newline_token) :]:
            c = step(c)
        return c

    assert run(spark, chain, texts) == [plain_chain(t) for t in texts]


def test_separator_codes_and_null(spark):
    assert run(spark, C.clean_text, ["a\x1cb", None, "  Hi @x!!!! 😀 "]) == ["a b", "", "Hi ::grinning_face"]


def test_plain_characters_in_pieces_are_those_of_the_whole_text(spark):
    """Every character by itself, in runs, at both ends, beside a cut mark and across line ends."""
    texts = ["", "a", "\r\n", "a\r\nb\r\r\n", "\r\x07\n", "\ufb03n\u2019\u201cx\u201d", "\uff21\uff22", "x\ufdd0y\u2019\ufdd0z", "\ufdd0", "\x01", "q\u2028\n\x85\n", None]
    table = str.maketrans(C.CURLED + C.WIDE, C.UNCURLED + C.NARROW)

    def whole(text):
        text = text.translate(table)
        for ligature, letters in C.LIGATURES.items():
            text = text.replace(ligature, letters)
        text = re.sub("\r\n|[\r\x85\u2028\u2029]", "\n", text)
        return re.sub("[\x00-\x08\x0b\x0e-\x1b\x7f\ufeff\u206a-\u206f\ufff9-\ufffc]", "", text)

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.plain_characters(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: None if t is None else whole(t) for i, t in enumerate(texts)}


def test_every_step_of_the_repair_is_evaluated_once(spark):
    """What a text is computed from stands in the plan once, not multiplied by every step that names its input several times."""
    df = spark.range(1).select(C.repair_text(F.format_string("caf\u00c3\u00a9 %s &amp;\n\u2019", "id")).alias("t"))
    assert df.first()["t"] == "caf\u00e9 0 &\n'"
    assert df._jdf.queryExecution().optimizedPlan().toString().count("format_string(") == 1
