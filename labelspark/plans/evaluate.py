"""Evaluation of heads on a corpus they were not learned from."""

from pyspark.sql import functions as F

from labelspark.operators.linear import predict
from labelspark.operators.scores import evaluate
from labelspark.operators.tokens import term_lists


def cross_corpus_eval(other, heads, id_col, pos_label=1):
    """Scores per task of (id, task, actual, text); rows whose task the heads lack are left out."""
    known = other.where(F.col("task").isNotNull())
    # an id names one text, however many tasks it has a row for
    pred = predict(term_lists(known.select(id_col, "text").dropDuplicates([id_col]), id_col), *heads, id_col)
    return evaluate(known.select(id_col, "task", "actual").join(pred, [id_col, "task"]), pos_label)
