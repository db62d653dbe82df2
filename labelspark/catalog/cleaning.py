"""Cleaning rules over whole tables."""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog import sql_text as S
from labelspark.catalog.registry import query
from labelspark.functions import clean as C


def _rule(name, rule, sql_rule, spark_input=None, sql_input="text"):
    """Registers one rule over all documents; the inputs may add the characters the rule is about."""
    source = spark_input if spark_input is not None else F.col
    oracle = f"select doc_id, {sql_rule(sql_input)} as text from documents"

    @query(name, oracle)
    def run(read, spark):
        text = source("text")
        return I.texts(read).select("doc_id", rule(text).alias("text"))


def _with_dates(name):
    stamp = F.concat(
        F.lit(" 2021-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:30 on March 5th, 2021. ")
    )
    return F.concat(F.col(name), stamp, F.col("doc_id").cast("string"))


_rule(
    "remove_dates",
    C.remove_dates,
    S.remove_dates,
    _with_dates,
    "(text || ' 2021-03-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || ' 10:30 on March 5th, 2021. ' || "
    "cast(doc_id as varchar))",
)
_rule("remove_mentions", C.remove_mentions, S.remove_mentions)
_rule("remove_hashtags", C.remove_hashtags, S.remove_hashtags)
_rule("remove_ips", C.remove_ips, S.remove_ips)
_rule(
    "remove_newline_token",
    C.remove_newline_token,
    S.remove_newline_token,
    lambda n: F.replace(F.col(n), F.lit("\n"), F.lit(" NEWLINE_TOKEN ")),
    "replace(text, chr(10), ' NEWLINE_TOKEN ')",
)
_rule(
    "limit_punct_repeats",
    C.limit_punct_repeats,
    S.limit_punct_repeats,
    lambda n: F.replace(F.col(n), F.lit("."), F.lit("!!!!...")),
    "replace(text, '.', '!!!!...')",
)
_rule(
    "space_after_punct",
    C.space_after_punct,
    S.space_after_punct,
    lambda n: F.replace(F.col(n), F.lit(", "), F.lit(",!")),
    "replace(text, ', ', ',!')",
)
_rule(
    "no_space_before_punct",
    C.no_space_before_punct,
    S.no_space_before_punct,
    lambda n: F.replace(F.col(n), F.lit("."), F.lit(" \t .")),
    "replace(text, '.', ' ' || chr(9) || ' .')",
)
_rule("collapse_spaces", C.collapse_spaces, S.collapse_spaces)
_rule("space_after_number", C.space_after_number, S.space_after_number)
_rule("space_before_number", C.space_before_number, S.space_before_number)
_rule("strip_edges", C.strip_edges, S.strip_edges)
_rule(
    "text_or_empty",
    C.text_or_empty,
    lambda e: f"coalesce({e}, '')",
    lambda n: F.when(F.col("lang") != "en", F.col(n)),
    "(case when lang <> 'en' then text end)",
)
# Every step of the chain has something to do: a wrong code page, references, plain forms, an emoji, a missing text.
SPOILED = "\ncafÃ©\nﬁne &amp; “ＡＢ”\r\nend\u0007 🔥 ok"
MENDED = "chr(10) || 'café' || chr(10) || 'fine & \"AB\"' || chr(10) || 'end  ::fire::  ok'"
_rule(
    "clean_text",
    C.clean_text,
    S.clean_text,
    lambda n: F.when(F.col("lang") != "es", F.concat(F.col(n), F.lit(SPOILED))),
    f"(case when lang <> 'es' then text || {MENDED} else '' end)",
)
_rule(
    "repair_text",
    C.repair_text,
    lambda e: e,
    lambda n: F.concat(F.col(n), F.lit("\ncafÃ©\n‘q’ „z” ﬀ ﬃ &lt; &#233; &#x1F525; &nothing; ５％\r.\u2028.\u0001")),
    "(text || chr(10) || 'café' || chr(10) || '''q'' \"z\" ff ffi < é 🔥 &nothing; 5%' || chr(10) || '.' || chr(10) || '.')",
)


# Letters with marks of their own, marks out of order, a syllable in parts, characters that stand for others, and an excluded composition.
PARTS = " q\u0307\u0323 \u1112\u1161\u11ab \u212b \u2126 \u0958 \ufb31 \u0344"
_rule(
    "compose",
    C.compose,
    lambda e: f"nfc_normalize({e})",
    lambda n: F.concat(F.replace(F.replace(F.col(n), F.lit("e"), F.lit("e\u0301")), F.lit("s"), F.lit("s\u030c\u0323")), F.lit(PARTS)),
    "(replace(replace(text, 'e', 'e' || chr(769)), 's', 's' || chr(780) || chr(803)) || '" + PARTS + "')",
)


@query("remove_urls", f"select page_id, {S.remove_urls(chr(39) + 'see ' + chr(39) + ' || url || ' + chr(39) + ' and ' + chr(39) + ' || html')} as text from pages")
def remove_urls(read, spark):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" and "), F.col("html"))
    return read("pages").select("page_id", C.remove_urls(text).alias("text"))


@query("fix_encoding", "select doc_id, text from documents union all select doc_id, text from documents")
def fix_encoding(read, spark):
    """Every text once as it is and once after its bytes were read with the wrong code page."""
    docs = I.texts(read).select("doc_id", "text")
    broken = F.translate(F.decode(F.encode("text", "utf-8"), "iso-8859-1"), C.C1_CHARS, C.CP1252_CHARS)
    both = docs.select("doc_id", F.explode(F.array(F.col("text"), broken)).alias("text"))
    return both.select("doc_id", C.fix_encoding(F.col("text")).alias("text"))


@query("fix_encoding_twice", "select doc_id, text || chr(10) || 'šūdas' as text from documents")
def fix_encoding_twice(read, spark):
    """Every text, and a line known to change, after its bytes were read with the wrong code page twice."""
    text = F.concat(F.col("text"), F.lit("\nšūdas"))
    for _ in range(2):
        text = F.translate(F.decode(F.encode(text, "utf-8"), "iso-8859-1"), C.C1_CHARS, C.CP1252_CHARS)
    return I.texts(read).select("doc_id", C.fix_encoding(text).alias("text"))


@query(
    "demojize",
    """
    select doc_id,
           replace(text, '.', case lang when 'en' then '. ::fire::  ::red_heart::  ::copyright:: '
                                        when 'de' then '. ::thumbs_up_medium_skin_tone::  ::flag_LT:: ✓'
                                        when 'fr' then '. ::keycap_1::  ::watch::  ::man_woman_girl:: '
                                        else '. ::broken_heart:: ' end) as text
    from documents
    """,
)
def demojize(read, spark):
    symbol = F.when(F.col("lang") == "en", ".🔥❤️©").when(F.col("lang") == "de", ".👍🏽🇱🇹✓")
    symbol = symbol.when(F.col("lang") == "fr", ".1️⃣⌚👨‍👩‍👧").otherwise(".💔")
    return I.texts(read).select("doc_id", C.demojize(F.replace("text", F.lit("."), symbol)).alias("text"))
