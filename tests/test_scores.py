"""Planted predictions against definitions written out in plain Python."""

import math

import pytest

from labelspark.operators import scores as S

SCHEMA = "task string, actual int, predicted int"


def scored(spark, pairs, **options):
    row = S.scores_by_task(spark.createDataFrame([("t", a, p) for a, p in pairs], SCHEMA), **options).first()
    return row.asDict()


def test_binary(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 9
    s = scored(spark, pairs)
    assert s["accuracy"] == pytest.approx(0.75)
    assert (s["precision"], s["recall"]) == (pytest.approx(6 / 9), pytest.approx(6 / 8))
    assert s["f1_score"] == pytest.approx(2 * (6 / 9) * 0.75 / (6 / 9 + 0.75))
    chance = (8 * 9 + 12 * 11) / 400
    assert s["kappa"] == pytest.approx((0.75 - chance) / (1 - chance))
    assert s["roc_auc"] == pytest.approx((6 / 8 + 9 / 12) / 2)
    zero = scored(spark, pairs, pos_label=0)
    assert (zero["precision"], zero["recall"]) == (pytest.approx(9 / 11), pytest.approx(9 / 12))


def test_no_predicted_and_no_actual_positive(spark):
    s = scored(spark, [(1, 0), (0, 0), (0, 0)])
    assert (s["precision"], s["recall"], s["f1_score"], s["kappa"], s["roc_auc"]) == (0, 0, 0, 0, 0.5)


def test_one_class(spark):
    s = scored(spark, [(1, 1)] * 4)
    assert math.isnan(s["kappa"]) and math.isnan(s["roc_auc"]) and s["accuracy"] == 1 and s["f1_score"] == 1
    s = scored(spark, [(1, 1), (1, 0)])
    assert math.isnan(s["roc_auc"]) and s["kappa"] == 0 and s["accuracy"] == 0.5


def test_three_classes_are_micro(spark):
    s = scored(spark, [(0, 0), (1, 1), (2, 0), (2, 2)])
    assert s["accuracy"] == s["precision"] == s["recall"] == s["f1_score"] == 0.75 and math.isnan(s["roc_auc"])


def test_class_count_of_the_model(spark):
    classes = spark.createDataFrame([("t", 3)], "task string, n_classes bigint")
    pairs = [(1, 1), (1, 0), (0, 0), (0, 2)]
    assert scored(spark, pairs)["precision"] == 1.0
    assert scored(spark, pairs, model_classes=classes)["precision"] == 0.5
    # the third predicted class outranks both: one of four pairs is lost to it, one of the four is a tie
    assert scored(spark, pairs)["roc_auc"] == pytest.approx((0.5 + 0 + 1 + 0) / 4)


def test_evaluate_leaves_out_unknown_tasks(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 0), ("b", None, 0)], SCHEMA)
    assert [r["task"] for r in S.evaluate(df).collect()] == ["a"]


def test_mean_ignores_nan(spark):
    df = spark.createDataFrame([("a", 0.5, float("nan")), ("b", float("nan"), float("nan"))], "task string, x double, y double")
    row = S.mean_over_tasks(df).first()
    assert row["x"] == 0.5 and math.isnan(row["y"])


def test_losses(spark):
    df = spark.createDataFrame([("t", 0, [0.8, 0.2]), ("t", 1, [0.4, 0.6]), ("t", 1, [0.0, 1.0])], "task string, actual int, probs array<double>")
    weights = spark.createDataFrame([("t", 0, 2.0)], "task string, label int, weight double")
    a, b = -math.log(0.8), -math.log(0.6)
    assert S.weighted_log_loss(df, weights).first()["loss"] == pytest.approx((2 * a + b) / 4)
    assert S.weighted_log_loss(df).first()["loss"] == pytest.approx((a + b) / 3)
    assert S.focal_loss(df, gamma=0).first()["loss"] == pytest.approx((a + b) / 3)
    assert S.focal_loss(df, weights).first()["loss"] == pytest.approx((2 * 0.04 * a + 0.16 * b) / 3)
    assert S.total_loss(S.weighted_log_loss(df)).first()["loss"] == pytest.approx((a + b) / 3)


def test_report_averages(spark):
    df = spark.createDataFrame([("t", 0, 0)] * 3 + [("t", 1, 0)], SCHEMA)
    rows = {r["label"]: r for r in S.classification_report(df).collect()}
    assert rows["0"]["precision"] == 0.75 and rows["1"]["f1_score"] == 0
    assert rows["macro avg"]["recall"] == 0.5 and rows["weighted avg"]["recall"] == 0.75 and rows["accuracy"]["f1_score"] == 0.75
