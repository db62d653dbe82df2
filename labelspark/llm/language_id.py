"""Language by compression: the language whose dictionary makes a text smallest.

Each language has one zstandard raw-content dictionary, text of that language as it is, from a bounded sample (`DICTIONARY_BYTES` bytes
from documents of the training folds whose id hashes lowest, `DOC_BYTES` of each). A text is lower-cased, reduced to letters and
single spaces and cut into blocks, all of them, so that a text's own beginning does not replace the dictionary; sizes are summed. The smallest
sum wins; `rejected` tells where the next language comes within `NARROW` of it.

Null texts and texts without a letter are `und` with score 0, as is everything where no language was learned. Equal sizes go to the
language first in order. Documents with null language or text teach nothing. Other columns are not read.
"""

import functools

import numpy as np
import regex
import zstandard
from pyspark.sql import functions as F

from labelspark.llm import shared

DICTIONARY_BYTES, DOC_BYTES, BLOCK = 1 << 17, 2048, 1500
#: A margin, as a share of the second size, under which a prediction counts as rejected, and the one that scores one half.
NARROW, HALF = 0.01, 0.03
#: At most so many bytes of dictionaries are sent to the executors.
SENT_BYTES = 64 << 20
OTHER, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text):
    return OTHER.sub(" ", text).strip().lower().encode("utf-8", "surrogatepass")


def train(docs, folds=3, held_out=1, id_col="doc_id", text_col="text", lang_col="lang"):
    """{language: dictionary bytes}"""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (shared.buckets_of(id_col, folds) != held_out))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    need = 2 * DICTIONARY_BYTES // DOC_BYTES
    # Rows per language fold to the lowest hashes before the shuffle: `need` bounded pieces per language and task.
    piece = F.struct(F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, DOC_BYTES).alias("piece"))
    parts = known.withColumn("slot", F.pmod(F.xxhash64("doc_id", "text"), F.lit(need)))
    lowest = parts.groupBy("lang", "slot").agg(F.min(piece).alias("p")).select("lang", "slot", "p.piece")
    rows = lowest.orderBy("lang", "slot").collect()
    gathered = {}
    for row in rows:
        gathered.setdefault(row["lang"], []).append(letters(row["piece"]))
    return {lang: b" ".join(x for x in found if x)[:DICTIONARY_BYTES] for lang, found in gathered.items() if any(found)}


@functools.lru_cache(maxsize=4)
def coders(model, level=6):
    return [
        zstandard.ZstdCompressor(
            level=level, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        )
        for _, data in model
    ]


def classify(texts, model):
    """(language, score, rejected) per text; `model` is a tuple of (language, dictionary)."""
    found, names = [], [name for name, _ in model]
    packers = coders(model)
    for text in texts:
        data = letters(text) if text is not None and LETTER.search(text) else b""
        if not data or not names:
            found.append(("und", 0.0, True))
            continue
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        sizes = np.array([sum(len(packer.compress(x)) for x in blocks) for packer in packers], dtype=np.float64)
        best = int(np.argmin(sizes))
        second = np.min(np.delete(sizes, best)) if len(sizes) > 1 else sizes[best] * 2
        margin = (second - sizes[best]) / second
        found.append((names[best], float(1 - 0.5 ** (margin / HALF)), bool(margin < NARROW)))
    return found


def predict(docs, dictionaries, folds=3, held_out=1, id_col="doc_id", text_col="text"):
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    spark = docs.sparkSession
    shared.ship(spark)
    if sum(map(len, dictionaries.values())) > SENT_BYTES:
        raise ValueError("more dictionaries than the stated bound; lower DICTIONARY_BYTES")
    sent = spark.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(columns):
        lang, score, rejected = zip(*classify(columns["text"], sent.value), strict=True)
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": lang, "score": score, "rejected": rejected}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (shared.buckets_of(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(shared.per_batch(run, schema), schema)
