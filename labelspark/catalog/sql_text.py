"""The cleaning rules as SQL strings, written for an engine whose regular expressions have no look-around."""

from labelspark.functions.clean import DATE_PATTERN

SPACE = r"[\s\x0b]"
NOT_SPACE = r"[^\s\x0b]"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def sub(expr, pattern, replacement, options="g"):
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)}, '{options}')"


def remove_dates(e):
    return sub(e, DATE_PATTERN, "", "gi")


def remove_urls(e):
    return sub(e, f"https?://{NOT_SPACE}+", "")


def remove_mentions(e):
    return sub(e, f"@{NOT_SPACE}+", "")


def remove_hashtags(e):
    return sub(e, f"#{NOT_SPACE}+", "")


def remove_ips(e):
    return sub(e, r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "")


def remove_newline_token(e):
    return f"replace({e}, 'NEWLINE_TOKEN', '')"


def limit_punct_repeats(e):
    for mark, twice in ((",", ",,"), (r"\.", ".."), (r"\?", "??"), ("!", "!!")):
        e = sub(e, mark + "{3,}", twice)
    return e


def space_after_punct(e):
    once = sub(e, f"([,.?!])({NOT_SPACE})", r"\1 \2")
    return sub(once, f"([,.?!])({NOT_SPACE})", r"\1 \2")


def no_space_before_punct(e):
    return sub(e, f"{SPACE}+([,.?!])", r"\1")


def collapse_spaces(e):
    return sub(e, SPACE + "{2,}", " ")


def space_after_number(e):
    return sub(e, r"(\d)([^\s\x0b\d,.?!-])", r"\1 \2")


def space_before_number(e):
    return sub(e, r"([^\s\x0b\d-])(\d)", r"\1 \2")


def strip_edges(e):
    chars = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~ "
    return f"trim({e}, '{chars}' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def clean_text(e):
    for step in (
        remove_dates,
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
    ):
        e = step(e)
    return e
