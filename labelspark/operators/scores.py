"""Scores per task. One aggregate over the predictions gives the confusion counts; all else is read off it."""

from pyspark.sql import Window as W, functions as F

from labelspark.operators.lookup import lookup_join

NAN = float("nan")


def confusion(pred):
    """Rows per task, actual and predicted class."""
    return pred.groupBy("task", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(counts):
    """Per task and class: rows of the class, rows predicted as it, and rows that are both."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("a"), zero.alias("p"), hit.cast("bigint").alias("t")),
        F.struct(F.col("predicted").alias("label"), zero.alias("a"), F.col("n").alias("p"), zero.alias("t")),
    )
    rows = counts.select("task", F.explode(sides).alias("_s")).select("task", "_s.*")
    return rows.groupBy("task", "label").agg(
        F.sum("a").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("correct")
    )


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _f1(precision, recall):
    return _ratio(2 * precision * recall, precision + recall)


def auc_of_predictions(counts):
    """Area under the curve when the predicted class itself is the score; NaN unless two classes occur."""
    ends = W.partitionBy("task")
    sides = counts.withColumn("_low", F.min("actual").over(ends)).withColumn("_high", F.max("actual").over(ends))
    sides = sides.withColumn("_odd", ((F.col("actual") != F.col("_low")) & (F.col("actual") != F.col("_high"))).cast("int"))
    by_score = sides.groupBy("task", "predicted").agg(
        F.sum(F.when(F.col("actual") == F.col("_high"), F.col("n")).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col("actual") == F.col("_high"), 0).otherwise(F.col("n"))).alias("_neg"),
        F.max("_odd").alias("_odd"),
        F.max((F.col("_low") == F.col("_high")).cast("int")).alias("_single"),
    )
    below = F.sum("_neg").over(W.partitionBy("task").orderBy("predicted")) - F.col("_neg")
    won = F.col("_pos") * (below + F.col("_neg") / 2)
    totals = by_score.withColumn("_won", won).groupBy("task").agg(
        F.sum("_won").alias("_won"),
        F.sum("_pos").alias("_pos"),
        F.sum("_neg").alias("_neg"),
        F.max(F.greatest("_odd", "_single")).alias("_undefined"),
    )
    auc = F.when(F.col("_undefined") == 1, F.lit(NAN)).otherwise(F.col("_won") / (F.col("_pos") * F.col("_neg")))
    return totals.select("task", auc.alias("roc_auc"))


def scores_by_task(pred, pos_label=1, model_classes=None):
    """One row per task: accuracy, f1_score, precision, recall, kappa, roc_auc.

    Tasks with two classes are scored on `pos_label`, all others as micro average. The number of classes
    is that of the model when `model_classes` (task, n_classes) is given, else that of the actual labels.
    """
    counts = confusion(pred)
    classes = per_class(counts)
    on_positive = F.col("label") == pos_label
    totals = classes.groupBy("task").agg(
        F.sum("support").alias("_n"),
        F.sum("correct").alias("_hits"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("_chance"),
        F.count_if(F.col("support") > 0).alias("_observed"),
        *[F.sum(F.when(on_positive, F.col(c)).otherwise(0)).alias(f"_pos_{c}") for c in ("support", "predicted", "correct")],
    )
    if model_classes is not None:
        totals = lookup_join(totals, model_classes.select("task", F.col("n_classes").alias("_model")), "task", "left")
    else:
        totals = totals.withColumn("_model", F.lit(None).cast("bigint"))
    accuracy = F.col("_hits") / F.col("_n")
    chance = F.col("_chance") / (F.col("_n").cast("double") * F.col("_n"))
    binary = F.coalesce("_model", "_observed") == 2
    precision = F.when(binary, _ratio(F.col("_pos_correct"), F.col("_pos_predicted"))).otherwise(accuracy)
    recall = F.when(binary, _ratio(F.col("_pos_correct"), F.col("_pos_support"))).otherwise(accuracy)
    kappa = F.when(chance == 1, F.lit(NAN)).otherwise((accuracy - chance) / (1 - chance))
    scores = totals.select(
        "task", accuracy.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), kappa.alias("kappa")
    ).withColumn("f1_score", _f1(F.col("precision"), F.col("recall")))
    scores = scores.join(auc_of_predictions(counts), "task")
    return scores.select("task", "accuracy", "f1_score", "precision", "recall", "kappa", "roc_auc")


def mean_over_tasks(scores):
    """Mean of each score over the tasks where it is a number; NaN when there is none."""
    names = [c for c in scores.columns if c != "task"]
    return scores.agg(*[F.coalesce(F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))), F.lit(NAN)).alias(c) for c in names])


def classification_report(pred):
    """Per task: one row per class, then accuracy, macro average and weighted average."""
    classes = per_class(confusion(pred))
    precision = _ratio(F.col("correct"), F.col("predicted"))
    recall = _ratio(F.col("correct"), F.col("support"))
    rows = classes.select(
        "task",
        F.col("label").cast("string").alias("label"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1_score"),
        "support",
        "correct",
    )
    names = ("precision", "recall", "f1_score")
    total = F.sum("support")
    averages = rows.groupBy("task").agg(
        F.struct(
            F.lit("accuracy").alias("label"),
            *[(F.sum("correct") / total).alias(n) for n in names],
            total.alias("support"),
        ).alias("accuracy"),
        F.struct(
            F.lit("macro avg").alias("label"), *[F.avg(n).alias(n) for n in names], total.alias("support")
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[(F.sum(F.col(n) * F.col("support")) / total).alias(n) for n in names],
            total.alias("support"),
        ).alias("weighted"),
    )
    below = averages.select("task", F.explode(F.array("accuracy", "macro", "weighted")).alias("_a")).select("task", "_a.*")
    return rows.drop("correct").unionByName(below)


def _with_nll(pred, weights):
    """Adds the probability of the actual class and its class weight (1 where no weight is given)."""
    rows = pred.withColumn("_p", F.element_at("probs", F.col("actual").cast("int") + 1).cast("double"))
    if weights is None:
        return rows.withColumn("_w", F.lit(1.0))
    table = weights.select("task", F.col("label").alias("actual"), F.col("weight").alias("_w"))
    return lookup_join(rows, table, ["task", "actual"], "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))


def weighted_log_loss(pred, weights=None):
    """Cross-entropy per task, sum of weighted losses over sum of weights."""
    rows = _with_nll(pred, weights)
    return rows.groupBy("task").agg((F.sum(-F.ln("_p") * F.col("_w")) / F.sum("_w")).alias("loss"))


def focal_loss(pred, weights=None, gamma=2.0):
    """Mean of weight * (1 - p)^gamma * -ln p per task."""
    loss = F.col("_w") * F.pow(1 - F.col("_p"), F.lit(float(gamma))) * -F.ln("_p")
    return _with_nll(pred, weights).groupBy("task").agg(F.avg(loss).alias("loss"))


def total_loss(losses):
    """Sum of the task losses."""
    return losses.agg(F.sum("loss").alias("loss"))


def evaluate(pred, pos_label=1, model_classes=None):
    """Scores over the rows whose task is known."""
    known = pred.where(F.col("task").isNotNull() & F.col("actual").isNotNull())
    return scores_by_task(known, pos_label, model_classes)
