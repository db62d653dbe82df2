"""Language of a text from character trigram profiles learned on a labelled table.

A trigram is a whole number, 21 bits per letter, so a text's trigrams are one NumPy expression over its letters: there is no row per
trigram, neither when profiles are counted nor when texts are scored against them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelspark.functions.columns import argmax
from labelspark.operators.linear import logits, offsets_of, weights_of
from labelspark.session import ship, written

#: Texts whose trigrams are made at a time.
TEXTS = 512


def letters(c):
    """Lower-case words of letters, set apart by one blank, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")), F.lit(" "))


def trigram_codes(column):
    """(trigrams of all texts in a row, how many each text has) of a column of letters."""
    texts = [x or "" for x in column.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(points) < 3:
        return pa.array([], pa.int64()), np.zeros(len(texts), np.int64)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    left = np.repeat(np.cumsum(lengths), lengths)[: len(codes)] - np.arange(len(codes))
    return pa.array(codes[left >= 3]), np.maximum(lengths - 2, 0)


def trigram_counts(df, text="text", lang="lang"):
    """(label, term, n): trigrams per language, folded inside each task before the shuffle."""
    ship(df.sparkSession)
    rows = df.select(F.col(lang).alias("label"), letters(F.col(text)).alias("_l"))
    schema = T.StructType([rows.schema.fields[0], *T.StructType.fromDDL("term long, n long").fields])
    fields = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                names, own = np.unique([str(x) for x in batch.column(0).to_pylist()], return_inverse=True)
                values = {str(x): x for x in batch.column(0).to_pylist()}
                codes, sizes = trigram_codes(batch.column(1))
                codes, owner = codes.to_numpy(zero_copy_only=False), np.repeat(own, sizes)
                for k, name in enumerate(names):
                    terms, n = np.unique(codes[owner == k], return_counts=True)
                    columns = [pa.array([values[name]] * len(terms), fields.field(0).type), pa.array(terms, pa.int64()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return rows.mapInArrow(run, schema).groupBy("label", "term").agg(F.sum("n").alias("n"))


def language_profiles(df, text="text", lang="lang"):
    """(weights, offsets): smoothed trigram shares per language, with equal priors."""
    counts = written(trigram_counts(df, text, lang).select(F.lit("language").alias("task"), "label", "term", "n"), "language-counts")
    priors = counts.select("task", "label").distinct().withColumn("bias", F.lit(0.0))
    return weights_of(counts), offsets_of(counts, priors)


def detect_language(df, profiles, id_col, text="text"):
    """(id, language): the most probable language; the smaller name wins a tie, no letters give null."""
    scored = logits(df.select(id_col, letters(F.col(text)).alias("_l")), *profiles, id_col, "_l", trigram_codes)
    best = F.col("labels")[argmax(F.col("logits"))]
    return scored.select(id_col, F.when(F.col("n_terms") > 0, best).alias("language"))


def keep_language(df, detected, id_col, language):
    """Rows whose detected language is the wanted one."""
    return df.join(detected.where(F.col("language") == language).select(id_col), id_col, "left_semi")


def language_report(detected, known, id_col, lang="lang"):
    """(label, n, n_right, n_undecided): how the rows of a labelled table were told, per label."""
    rows = known.select(id_col, F.col(lang).alias("label")).join(detected, id_col)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("language").eqNullSafe(F.col("label"))).alias("n_right"),
        F.count_if(F.col("language").isNull()).alias("n_undecided"),
    )
