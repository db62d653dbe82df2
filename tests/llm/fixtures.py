"""Small tables for the tests of this folder."""

import random

from pyspark.sql import types as T

#: Names that the operators use for columns of their own.
CLASHING = ("key", "cell", "bucket", "node", "part", "hash", "word", "block", "anchor", "kept", "_dropped")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in CLASHING]
)
SYLLABLES = "ba be bi do du da ka ki lo la mi mo na ne po ra ri sa so ta te ti vo wa zu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    out = []
    for k in range(n):
        w = word(rng)
        out.append(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang) with clashing extra columns, null in places."""
    full = []
    for k, row in enumerate(rows):
        doc, text, lang = (*row, None)[:3]
        extra = [None if k % 3 == 0 else name for name in CLASHING]
        full.append((doc, text, lang, None if k % 4 == 0 else "src0", None if text is None else len(text), *extra))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, empty, null and long ones."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    for k in range(0, n, 6):
        texts.append(texts[k])
        words = texts[k + 1].split()
        if len(words) > 3:
            words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        texts.append(prose(rng, 5) + " " + passage + " " + prose(rng, 7))
    texts += ["", None, "", None, " \n\t ", "one", "One", "two words", prose(rng, 6000), "ha " * 400, "x" * 900, "naïve café — 東京 ß İ 👍"]
    return [(k, text) for k, text in enumerate(texts)]


def edge_rows(seed=1):
    """The corpus with a null id, a repeated row and a repeated id."""
    rows = corpus(seed)
    return rows + [(None, rows[3][1]), (None, "only here"), rows[5], (7, "another text of seven")]
