"""Classifier heads on shared text features: one per task, wide or long, single target, and sweeps.

Every head, of whatever size, is one softmax regression on the same weighed words of cleaned texts, and all heads of a call are fitted
together (`operators.descent`): the number of jobs depends on the steps only.
"""

from pyspark.sql import functions as F

from labelspark.functions.clean import clean_text
from labelspark.operators import descent as D
from labelspark.operators.labels import class_map, class_weights
from labelspark.operators.reshape import wide_to_long
from labelspark.operators.scores import scores_by_task
from labelspark.operators.split import seeded_split
from labelspark.session import written

FEATURES = 1 << 16
STEPS, RATE, PATIENCE = 30, 0.5, 5


def _known(df):
    return df.where(F.col("task").isNotNull() & F.col("value").isNotNull())


def _marked(train, valid, features):
    """(task, value, valid, text keys) of both tables and the words of their texts; without a second one no row is for validation."""
    rows = train.select("text", "task", "value").withColumn("valid", F.lit(False))
    if valid is not None:
        rows = rows.unionByName(valid.select("text", "task", "value").withColumn("valid", F.lit(True)))
    rows = _known(rows).withColumns(D.text_keys())
    return written(rows.drop("text"), "head-rows"), written(D.hashed_words(rows, features, clean_text), "head-words")


def _listed(train):
    """([(task, [(class value, balanced weight), ...]), ...], class map) of the rows that teach, in sorted order."""
    classes = written(class_map(train), "classes")
    found = class_weights(train).join(classes, ["task", "value"]).orderBy("task", "idx").collect()
    listed = {}
    for row in found:
        listed.setdefault(row["task"], []).append((row["value"], row["weight"]))
    return list(listed.items()), classes


def train_heads_long(df, id_col, max_iter=STEPS, reg=0.01, features=FEATURES, valid=None, patience=PATIENCE, rate=RATE):
    """(features, heads, class map) from a long table (id, text, task, value); a row trains its task only.

    With a table `valid` of the same form every head keeps the weights of its best accuracy there and stops after `patience` steps without a
    better one. A task of one class has nothing to learn; its class is always predicted. Rows without a task or value teach nothing.
    """
    rows, words = _marked(df, valid, features)
    taught = rows.where(~F.col("valid"))
    model = D.fit_features(words.join(taught.select(*D.TEXT_KEY).distinct(), list(D.TEXT_KEY), "left_semi"), features)
    listed, classes = _listed(taught)
    return model, D.fit_heads(rows, words, model, listed, [reg] * len(listed), max_iter, rate, patience), classes


def predict_long(df, model, heads, classes, id_col):
    """Predictions of each row's own task: (id, task, actual, predicted, probs); rows of tasks without a head are left out.

    Every distinct text is cleaned and weighed once, for all its tasks.
    """
    rows = df.select(id_col, "task", "value", "text").where(F.col("task").isNotNull()).withColumns(D.text_keys())
    words, rows = D.hashed_words(rows, model.size, clean_text), written(rows.drop("text"), "head-rows")
    found = D.apply_heads(rows, words, model, heads)
    names = classes.select("task", F.col("idx").cast("int").alias("idx"), F.col("value").alias("predicted"))
    named = rows.join(found, [*D.TEXT_KEY, "task"]).join(F.broadcast(written(names, "head-names")), ["task", "idx"])
    return named.select(id_col, "task", F.col("value").alias("actual"), "predicted", "probs")


def predict_rows(df, model, heads, keep):
    """(keep..., task, idx, probs) for every row and head, row by row without a shuffle: also for texts that arrive."""
    return D.apply_to_rows(df.select(*keep, D.word_list(model.size, clean_text).alias("words")), model, heads, keep)


def train_heads_wide(df, id_col, targets, max_iter=STEPS, reg=0.01, features=FEATURES, valid=None, patience=PATIENCE):
    """(features, heads) from a wide table: one class-weighted head per target column, fitted together.

    Columns of one class have nothing to learn and get no head.
    """

    def long(wide):
        return wide_to_long(wide.select("text", *[F.col(c).cast("int").alias(c) for c in targets]), "text", targets)

    taught = _known(long(df))
    sizes = taught.groupBy("task").agg(F.count_distinct("value").alias("k")).where("k > 1")
    taught = taught.join(F.broadcast(written(sizes.select("task"), "head-tasks")), "task", "left_semi")
    model, heads, _ = train_heads_long(taught, id_col, max_iter, reg, features, None if valid is None else long(valid), patience)
    return model, heads


def predict_wide(df, model, heads, id_col):
    """Long predictions of every head; the words of a text are weighed once for all heads."""
    spark = df.sparkSession
    names = spark.createDataFrame([(t, v, k) for t, values in heads.classes for k, v in enumerate(values)], "task string, value int, idx int")
    long = wide_to_long(df.select(id_col, "text", *[F.col(t).cast("int").alias(t) for t in heads]), [id_col, "text"], list(heads))
    return predict_long(long, model, heads, names, id_col)


def train_simple(df, id_col, target, train=0.7, valid=0.15, seed=42, max_iter=STEPS, reg=0.01, features=FEATURES, pos_label=1):
    """(features, heads, scores on the test split) for one target column, text cleaned first; the validation split says when to stop."""
    split = seeded_split(df.select(id_col, "text", F.col(target).cast("int").alias("value")), id_col, train, valid, seed)
    rows = written(split.withColumn("task", F.lit(target)), "simple-splits")
    part = lambda name: rows.where(F.col("split") == name)
    model, heads, classes = train_heads_long(part("train"), id_col, max_iter, reg, features, part("validation"))
    scores = scores_by_task(predict_long(part("test"), model, heads, classes, id_col), pos_label)
    return model, heads, written(scores, "simple-scores")


def sweep(train, valid, id_col, target, regs, steps=(5, 10, 20), patience=2, features=FEATURES, rate=RATE):
    """One row per scored setting: (reg, max_iter, accuracy, best).

    All regularisations are heads of one fit that goes on from step to step; each is scored at the numbers of iterations in `steps` until
    its accuracy on the validation rows has not improved `patience` times in a row.
    """
    long = lambda df: df.select("text", F.lit(target).alias("task"), F.col(target).alias("value"))
    rows, words = _marked(long(train), long(valid), features)
    taught = rows.where(~F.col("valid"))
    model = D.fit_features(words.join(taught.select(*D.TEXT_KEY).distinct(), list(D.TEXT_KEY), "left_semi"), features)
    listed, _ = _listed(taught)
    copies = [((task, reg), own) for task, own in listed for reg in regs]
    heads = D.fit_heads(rows, words, model, copies, [reg for _ in listed for reg in regs], max(steps), rate, max(steps) + 1)
    results = []
    for reg in regs:
        told = {step: accuracy for (_, own), step, accuracy in heads.history if own == reg}
        best, waited = -1.0, 0
        for step in steps:
            if step not in told:
                break
            results.append((float(reg), int(step), told[step]))
            waited = 0 if told[step] > best else waited + 1
            best = max(best, told[step])
            if waited >= patience:
                break
    top = max(results, key=lambda r: (r[2], -r[1], r[0]), default=None)
    table = [(*r, r == top) for r in results]
    return train.sparkSession.createDataFrame(table, "reg double, max_iter int, accuracy double, best boolean")
