"""Text cleaning as column expressions; every function maps a string column to a string column."""

import string
from html.entities import html5

from pyspark.sql import functions as F

from labelspark.functions.emoji_names import emoji_names, emoji_sequence

# The 27 characters windows-1252 has where ISO-8859-1 has control codes, in byte order.
CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
CP1252_CHARS = bytes(CP1252_BYTES).decode("cp1252")
C1_CHARS = bytes(CP1252_BYTES).decode("latin-1")

# The patterns of the cleaning rules, in the order they apply.
URL = r"https?://\S+"
MENTION = r"@\S+"
HASHTAG = r"#\S+"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
NEWLINE_TOKEN = "NEWLINE_TOKEN"
REPEATED_MARK = r"([,.?!])\1{2,}"
MARK_BEFORE_TEXT = r"([,.?!])(?=\S)"
SPACE_BEFORE_MARK = r"\s+([,.?!])"
MANY_SPACES = r"\s{2,}"
NUMBER_BEFORE_TEXT = r"(\d)(?=[^\s\d,.?!-])"
NUMBER_AFTER_TEXT = r"(?<=[^\s\d-])(\d)"

# The date and time expressions that are removed.
MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
    "nov(?:ember)?|dec(?:ember)?"
)
CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
DATES = (
    rf"\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(?:[T ]{CLOCK}(?:Z|[+-]\d{{2}}:?\d{{2}})?)?"
    r"|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
    r"|\d{1,2}\.\d{1,2}\.\d{4}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)? (?:of )?(?:{MONTHS})\.?(?:,? \d{{4}})?"
    rf"|(?:{MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,? \d{{4}})?"
    rf"|(?:{MONTHS}) \d{{4}}"
    rf"|{CLOCK}(?: ?[ap]m)?"
)
DATE_PATTERN = rf"\b(?:{DATES})\b"
DATE_START = r"(?=[\dJFMASONDjfmasond])"

# Characters with a plain form.
CURLED, UNCURLED = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f", "''''\"\"\"\""
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "\u0132": "IJ", "\u0133": "ij"}
LINE_BREAK = "\\r\\n|[\\r\\x{85}\\x{2028}\\x{2029}]"
CONTROLS = "[\\x00-\\x08\\x0b\\x0e-\\x1b\\x7f\\x{feff}\\x{206a}-\\x{206f}\\x{fff9}-\\x{fffc}]"
# What the texts are searched for before any of these is replaced.
SPECIAL = (
    "[\\x00-\\x08\\x0b\\x0d-\\x1b\\x7f\\x{85}\\x{132}\\x{133}\\x{2018}-\\x{201f}\\x{2028}\\x{2029}\\x{206a}-\\x{206f}"
    "\\x{3000}\\x{fb00}-\\x{fb06}\\x{feff}-\\x{ff5e}\\x{fff9}-\\x{fffc}]"
)

# Two characters that may be bytes of one, how often a line may have been garbled, and the first characters that may have another normal form.
GARBLED = f"[\\xc2-\\xf4][\\x80-\\xbf{CP1252_CHARS}]"
GARBLED_TIMES = 3
FROM_MARKS = "[\\x{300}-\\x{10ffff}]"

EDGE_CHARS = string.punctuation + string.whitespace
CUT = "\ufdd0"  # a code point that is never a character


def once(c, step):
    """`step(c)` with `c` evaluated once, however often the step names it: a lambda's variable is a value, a repeated expression is computed again."""
    return F.get(F.transform(F.array(c), step), F.lit(0))


def text_or_empty(c):
    """Null becomes the empty string."""
    return F.coalesce(c, F.lit(""))


def fix_encoding(c):
    """Repairs lines whose UTF-8 bytes were read as windows-1252, up to `GARBLED_TIMES` times over; other lines stay as they are."""

    def repaired(line):
        single_bytes = F.regexp_replace(F.translate(line, CP1252_CHARS, C1_CHARS), "[^\\x00-\\xff]", "\xff")
        text = F.try_validate_utf8(F.encode(single_bytes, "iso-8859-1").cast("string"))
        return F.when(line.rlike(GARBLED), F.coalesce(text, line)).otherwise(line)

    def mended(line):
        for _ in range(GARBLED_TIMES):
            line = once(line, repaired)
        return line

    # lines without a garbled pair are searched once
    lines = F.transform(F.split(c, "\n", -1), lambda line: F.when(line.rlike(GARBLED), mended(line)).otherwise(line))
    return F.when(c.rlike(GARBLED), F.array_join(lines, "\n")).otherwise(c)


def compose(c):
    """Normal form C: letters and the marks behind them as one character where there is one. No character below U+0300 changes by it."""
    return F.when(c.rlike(FROM_MARKS), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def unescape_entities(c):
    """Named and numbered character references, in texts without a tag; unknown names stay."""
    table = "\n".join(f"{name}\t{text}" for name, text in html5.items() if name.endswith(";") and not {"\n", "\t"} & set(text))
    names = F.str_to_map(F.lit(table), F.lit("\n"), F.lit("\t"))
    marked = F.regexp_replace(c, "&(#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,31};)", f"{CUT}$1{CUT}")

    def text_of(ref):
        hexed = F.lower(F.substring(ref, 2, 1)) == "x"
        digits = F.btrim(ref, F.lit("#xX;"))
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        known = code.between(9, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")
        found = F.when(F.startswith(ref, F.lit("#")), F.when(known, number)).otherwise(F.try_element_at(names, ref))
        return F.coalesce(found, F.concat(F.lit("&"), ref))

    pieces = F.transform(F.split(marked, CUT, -1), lambda p, i: F.when(i % 2 == 1, text_of(p)).otherwise(p))
    return F.when(F.contains(c, F.lit("<")) | ~F.contains(c, F.lit("&")), c).otherwise(F.array_join(pieces, ""))


def plain_characters(c):
    """Curly quotes, ligatures, full-width letters, line breaks and control codes in their plain form.

    The text is cut at such characters, and only these pieces are translated.
    """

    def plain(piece):
        piece = F.translate(piece, CURLED + WIDE, UNCURLED + NARROW)
        for ligature, letters in LIGATURES.items():
            piece = F.replace(piece, F.lit(ligature), F.lit(letters))
        return F.regexp_replace(F.regexp_replace(piece, LINE_BREAK, "\n"), CONTROLS, "")

    # a line feed stays with the carriage return before it
    marked = F.regexp_replace(c, f"({SPECIAL}+\n?)", f"{CUT}$1{CUT}")
    pieces = F.transform(F.split(marked, CUT, -1), lambda p, i: F.when(i % 2 == 1, plain(p)).otherwise(p))
    cut = F.when(F.contains(c, F.lit(CUT)), plain(c)).otherwise(F.array_join(pieces, ""))
    return F.when(c.rlike(SPECIAL), cut).otherwise(c)


def repair_text(c):
    """Wrong code pages, character references, characters with a plain form, and letters with marks of their own."""
    for step in (fix_encoding, unescape_entities, plain_characters, compose):
        c = once(c, step)
    return c


def remove_dates(c):
    """Deletes date and time expressions of the documented forms."""
    return F.regexp_replace(c, f"(?i){DATE_START}{DATE_PATTERN}", "")


def _sub(c, pattern, replacement):
    """White space, digits and words of any script."""
    return F.regexp_replace(c, f"(?U){pattern}", replacement)


def remove_urls(c):
    return _sub(c, URL, "")


def remove_mentions(c):
    return _sub(c, MENTION, "")


def remove_hashtags(c):
    return _sub(c, HASHTAG, "")


def remove_ips(c):
    """Dotted quads, without a range check."""
    return _sub(c, IP, "")


def remove_newline_token(c):
    return F.replace(c, F.lit(NEWLINE_TOKEN), F.lit(""))


def limit_punct_repeats(c):
    """Three or more equal marks become two."""
    return _sub(c, REPEATED_MARK, "$1$1")


def space_after_punct(c):
    return _sub(c, MARK_BEFORE_TEXT, "$1 ")


def no_space_before_punct(c):
    return _sub(c, SPACE_BEFORE_MARK, "$1")


def collapse_spaces(c):
    return _sub(c, MANY_SPACES, " ")


def space_after_number(c):
    return _sub(c, NUMBER_BEFORE_TEXT, "$1 ")


def space_before_number(c):
    return _sub(c, NUMBER_AFTER_TEXT, " $1")


def demojize(c):
    """Each emoji becomes ` ::name:: `, a joined one or one with a tone too; a flag is named by its two letters.

    The text is cut at emoji only, so a text without any stays one piece and is never looked up.
    """
    table = "\n".join(f"{symbol}\t{name}" for symbol, name in emoji_names().items())
    names = F.str_to_map(F.lit(table), F.lit("\n"), F.lit("\t"))
    marked = F.regexp_replace(c, f"({emoji_sequence()})", f"{CUT}$1{CUT}")

    def named(symbol):
        letters = F.regexp_extract_all(symbol, F.lit("[\\x{1F1E6}-\\x{1F1FF}]"), F.lit(0))
        letter = F.transform(letters, lambda x: F.char(F.conv(F.right(F.hex(F.encode(x, "utf-8")), F.lit(2)), 16, 10).cast("int") - 0xA6 + 65))
        parts = F.regexp_extract_all(symbol, F.lit("[^\\x{200D}\\x{FE0F}]"), F.lit(0))
        joined = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(names, x), x)), "_")
        name = F.when(F.size(letters) == 2, F.concat(F.lit("flag_"), F.array_join(letter, "")))
        name = name.when(F.contains(symbol, F.lit("\u20e3")), F.concat(F.lit("keycap_"), F.substring(symbol, 1, 1))).otherwise(joined)
        return F.concat(F.lit(" ::"), name, F.lit(":: "))

    # the marks stand on both sides, so every second piece is an emoji
    pieces = F.transform(F.split(marked, CUT, -1), lambda p, i: F.when(i % 2 == 1, named(p)).otherwise(p))
    return F.array_join(pieces, "")


def strip_edges(c):
    """Trims ASCII punctuation and white space from both ends."""
    return F.btrim(c, F.lit(EDGE_CHARS))


def separators_as_space(c):
    """The four ASCII separator codes count as white space in Python but not in Java: make them spaces."""
    return F.regexp_replace(c, r"[\x1c-\x1f]", " ")


CLEAN_STEPS = (
    text_or_empty,
    repair_text,
    remove_dates,
    demojize,
    separators_as_space,
    remove_urls,
    remove_mentions,
    remove_hashtags,
    remove_ips,
    remove_newline_token,
    limit_punct_repeats,
    space_after_punct,
    no_space_before_punct,
    collapse_spaces,
    space_after_number,
    space_before_number,
    strip_edges,
)


def clean_text(c):
    """All cleaning steps in their fixed order."""
    for step in CLEAN_STEPS:
        c = step(c)
    return c
