"""Tokens: vocabulary, fixed-length encoding, word pieces, pooled vectors, term features."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelspark.operators.lookup import lookup_join
from labelspark.operators.ranks import CHUNK, running_sum
from labelspark.operators.tiers import listed_terms
from labelspark.session import ship, written

PAD, UNKNOWN = 0, 1
#: Tokens of a vocabulary that are sent to the executors, some 10 MB in every Python worker; what stands for the others until they are joined.
SENT_TOKENS, LEFT = 1 << 17, -1


def tokens(c):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")


def vocabulary(df, text="text", max_size=None):
    """(token, token_id, n): all tokens, ids from 2 by falling count, then name; only the first `max_size` if given.

    Tokens are sorted over ranges and written in that order; a token's id is its place in its range and the totals of
    the ranges before, so no task numbers all of them.
    """
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.withColumn("_r", -F.col("n")).repartitionByRange("_r", "token").sortWithinPartitions("_r", "token")
    place = F.monotonically_increasing_id()
    ordered = ordered.select("token", "n", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_i"))
    ordered = written(ordered, "vocabulary")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")
    rows = lookup_join(ordered, sizes.select("_part", before.alias("_before")), "_part")
    rows = rows.select("token", (F.col("_before") + F.col("_i") + UNKNOWN + 1).cast("int").alias("token_id"), "n")
    return rows if max_size is None else rows.where(F.col("token_id") <= max_size + UNKNOWN)


def encode_tokens(df, vocab, id_col, max_len, text="text"):
    """`input_ids`, `attention_mask` and `token_type_ids` of exactly `max_len` positions, the encoder's width.

    Ids rise with falling frequency, so the first `SENT_TOKENS` tokens are sent to the executors and looked up inside the row. Only in a
    larger vocabulary are the tokens that a text has left over joined, a row each.
    """
    spark = df.sparkSession
    ship(spark)
    listed = vocab.select("token", "token_id")
    rare = listed.where(F.col("token_id") > SENT_TOKENS + UNKNOWN)
    found = listed.where(F.col("token_id") <= SENT_TOKENS + UNKNOWN).toArrow()
    more = found.num_rows >= SENT_TOKENS and not rare.isEmpty()
    known = found.column("token").combine_chunks()
    numbers = np.append(found.column("token_id").to_numpy(), LEFT if more else UNKNOWN).astype(np.int32)
    sent = spark.sparkContext.broadcast((known, numbers))
    rows = df.select(id_col, F.coalesce(F.slice(tokens(F.col(text)), 1, max_len), F.array().cast("array<string>")).alias("_t"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("_i", T.ArrayType(T.IntegerType())), T.StructField("_t", T.ArrayType(T.StringType()))])
    fields = to_arrow_schema(schema)

    def run(batches):
        known, numbers = sent.value
        for batch in batches:
            flat, sizes = listed_terms(batch.column(1))
            ids = numbers[pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False)]
            coded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((batch.column(0), coded, batch.column(1)), fields, strict=True)], schema=fields)

    coded = rows.mapInArrow(run, schema)
    if more:
        coded = written(coded, "coded-tokens")
        left = F.filter(F.transform("_t", lambda t, k: F.when(F.get("_i", k) == LEFT, F.struct(k.alias("k"), t.alias("token")))), lambda x: x.isNotNull())
        rest = coded.select(id_col, F.explode(left).alias("_x")).select(id_col, "_x.*").join(rare, "token")
        rest = rest.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("k", "token_id"))).alias("_m"))
        own = F.transform("_i", lambda x, k: F.when(x == LEFT, F.coalesce(F.try_element_at("_m", k), F.lit(UNKNOWN))).otherwise(x))
        coded = coded.join(rest, id_col, "left").withColumn("_i", own)
    gap = F.lit(max_len) - F.size("_i")
    return coded.select(
        id_col,
        F.concat("_i", F.array_repeat(F.lit(PAD), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_i")), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
        F.array_repeat(F.lit(0), max_len).alias("token_type_ids"),
    )


def merge_wordpieces(pieces, groups=("doc",), position="pos", token="token", score="attribution", chunk=CHUNK):
    """Words from pieces: `##` continues a word, the word's score is the largest of its pieces.

    Only texts of more than `chunk` pieces are numbered chunk by chunk; a window per text does for the others.
    """
    groups = list(groups)
    starts = pieces.withColumn("_start", (~F.startswith(F.col(token), F.lit("##"))).cast("bigint"))
    long = written(starts.groupBy(*groups).agg(F.max(position).alias("_last")).where(F.col("_last") >= chunk).select(*groups), "long-texts")
    word = F.sum("_start").over(W.partitionBy(*groups).orderBy(position))
    if long.limit(1).count():
        short = starts.join(long, groups, "left_anti").withColumn("word_no", word)
        numbered = running_sum(starts.join(long, groups, "left_semi"), groups, position, "_start", "word_no", chunk)
        numbered = short.unionByName(numbered)
    else:
        numbered = starts.withColumn("word_no", word)
    plain = F.regexp_replace(token, "^##", "")
    words = numbered.groupBy(*groups, "word_no").agg(
        F.array_sort(F.collect_list(F.struct(position, plain.alias("piece")))).alias("_p"), F.max(score).alias(score)
    )
    return words.withColumn("word", F.array_join(F.transform("_p", lambda x: x["piece"]), "")).drop("_p")


def pool(vectors, key, mode, position="pos", vector="vector", mask="mask"):
    """One vector per key from its position vectors: first, mean under the mask, or last unmasked."""
    if mode == "cls":
        return vectors.groupBy(key).agg(F.min_by(vector, position).alias("pooled"))
    kept = vectors.where(F.col(mask) == 1)
    if mode == "last":
        return kept.groupBy(key).agg(F.max_by(vector, position).alias("pooled"))
    if mode == "mean":
        return kept.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("pooled"))
    raise ValueError("mode is one of 'cls', 'mean', 'last'")


def term_lists(df, id_col, text="text"):
    """(id, terms): the tokens of each text, none for a missing text."""
    return df.select(id_col, tokens(F.coalesce(text, F.lit(""))).alias("terms"))
