"""Planted rows for derivations, votes, grids, class maps, reshapes and generated rows."""

import pytest
from pyspark.sql import functions as F

from labelspark.functions import columns as C
from labelspark.functions import generated as G
from labelspark.operators import generated as GO
from labelspark.operators import labels as L
from labelspark.operators.grid import Grid
from labelspark.operators import lookup as K
from labelspark.operators import reshape as R


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_normalise_target(spark):
    df = spark.createDataFrame([("  a b ",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(C.normalise_target(F.col("t"))).collect()] == ["a-b", "Other", "x"]


def test_frequent_targets_need_more_than_five(spark):
    df = spark.createDataFrame([("five",)] * 5 + [("six",)] * 6, "target string")
    assert rows(L.keep_frequent_targets(df), "target") == [("six",)] * 6


def test_votes_ties_nulls_single(spark):
    df = spark.createDataFrame(
        [(1, 2, 1), (1, 1, 0), (1, 1, 1), (1, 2, 0), (2, None, None), (2, 3, 1), (3, 9, 0)], "k int, v int, f int"
    )
    for options in ({"flags": ["f"]}, {}):
        voted = L.majority_vote(df, "k", ["v", "f"], **options)
        assert rows(voted, "k", "v", "f") == [(1, 1, 0), (2, 3, 1), (3, 9, 0)]
    silent = spark.createDataFrame([(1, None, None)], df.schema)
    assert rows(L.majority_vote(df.union(silent.selectExpr("4", "v", "f")), "k", ["v", "f"], ["f"]), "k", "v", "f")[-1] == (4, None, None)


def test_grid_and_overlay(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", 1), (2, "a", "x", 2), (3, "a", "y", 0), (4, "b", "y", 1), (5, None, "x", 1)],
        "i int, text string, target string, value int",
    )
    known = df.where(F.col("text").isNotNull())
    grid = L.complete_grid(known)
    assert rows(L.completed_values(known, "i"), "text", "target", "value") == rows(L.overlay_values(grid, known, "i"), "text", "target", "value")
    assert rows(L.overlay_values(grid, known, "i"), "text", "target", "value") == [
        ("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)
    ]


def test_pairs_are_bounded_and_need_no_join(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").cast("string").alias("text"))
    values = spark.range(9).select(F.concat(F.lit("t"), "id").alias("target"))
    expected = sorted((str(i), f"t{k}") for i in range(50) for k in range(9))
    nulls = values.unionByName(spark.createDataFrame([(None,), ("t1",)], "target string"))
    assert rows(K.pair_all(df, nulls, "target"), "text", "target") == expected
    assert K.pair_all(df, values.where("false"), "target").count() == 0
    plan = K.pair_all(df, values, "target")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0] and "xxhash64" not in plan
    monkeypatch.setattr(K, "PAIRED_BYTES", 8)
    with pytest.raises(ValueError, match="the bound is"):
        K.beside_all(df, values, "v")


def test_a_grid_in_factors_is_the_grid(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, 0), ("a", "x", 2, 2), ("a", "y", 0, 1), ("b", "y", 1, 3), ("c", None, 1, 5), (None, "x", 1, 6), ("b", "x", 0, 9)], "text string, target string, value int, i int"
    )
    known = df.where("text is not null and target is not null")
    grid = Grid.of_rows(known, "i")
    plain = rows(L.overlay_values(L.complete_grid(known), known, "i"), "text", "target", "value")
    assert rows(grid.with_texts(grid.unfolded()), "text", "target", "value") == plain
    assert rows(grid.wide(["x", "y", "z"]), "text", "x", "y", "z") == [("a", 2, 0, 0), ("b", 0, 1, 0)]
    assert rows(grid.counts(), "target", "value", "n") == [("x", 0, 1), ("x", 2, 1), ("y", 0, 1), ("y", 1, 1)]
    # a text of unknown targets only is still a text of the grid
    assert len(Grid.of_rows(df.where("text is not null"), "i").unfolded().collect()) == 6
    plan = grid.wide(["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
    typed = spark.createDataFrame([(1, ["p", "p", "q"]), (2, []), (3, None)], "i int, types array<string>")
    types = Grid.of_types(typed, "i")
    assert rows(types.wide(["p", "q"]), "i", "p", "q") == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]
    assert rows(types.unfolded(), "i", "target", "value") == sorted((i, t, int(i == 1)) for i in (1, 2, 3) for t in "pq")


def test_generated_rows_without_a_source(spark):
    generated = spark.createDataFrame([("t", 1), ("u", 2), ("u", 3), (None, 4)], "original_comment string, k int")
    labelled = spark.createDataFrame([("t", "x"), ("t", "y"), (None, "z")], "text string, labels string")
    assert sorted((r["original_comment"] or "", r["n"]) for r in L.unmatched_generated(generated, labelled).collect()) == [("", 1), ("u", 2)]
    assert rows(L.relabel_generated(generated, labelled), "original_comment", "labels") == [("t", "x"), ("t", "y")]


def test_lookup_joins(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 37).alias("k"))
    small = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = K.lookup_join(big, small, "k", how), big.join(small, "k", how)
        assert rows(a, *a.columns) == rows(b, *a.columns)


def test_a_source_text_of_several_rows_gives_all_labels(spark):
    generated = spark.createDataFrame([("t", "?"), ("u", "?")], "original_comment string, labels string")
    source = spark.createDataFrame([("t", "a"), ("t", "b")], "text string, labels string")
    assert rows(L.relabel_generated(generated, source), "original_comment", "labels") == [("t", "a"), ("t", "b")]


def test_class_map_and_policies(spark):
    df = spark.createDataFrame([("a", "no"), ("a", "yes"), ("b", "1"), ("c", "1")], "task string, value string")
    classes = L.class_map(df.where("task <> 'c'"))
    assert rows(classes, "task", "value", "idx") == [("a", "no", 0), ("a", "yes", 1), ("b", "1", 0)]
    for policy in ("warn", "ignore"):
        coded = L.encode_labels(df, classes, policy)
        assert rows(coded, "task", "task_idx", "label_idx") == [("a", 0, 0), ("a", 0, 1), ("b", 1, 0), ("c", None, None)]
    with pytest.raises(Exception, match="no task c"):
        L.encode_labels(df, classes, "error").collect()
    with pytest.raises(Exception, match="no class for label maybe"):
        L.encode_labels(spark.createDataFrame([("a", "maybe")], df.schema), classes).collect()
    with pytest.raises(ValueError):
        L.encode_labels(df, classes, "skip")


def test_cast_label_type(spark):
    df = spark.createDataFrame([("1",), (None,)], "value string")
    assert [r[0] for r in L.cast_label_type(df, "int").collect()] == [1, None]
    with pytest.raises(Exception, match="does not fit"):
        L.cast_label_type(spark.createDataFrame([("x",)], df.schema), "int").collect()


def test_wide_forms(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", 1), (2, "a", "y", 1), (3, "b", "y", 0), (4, "b", "y", 1), (5, "c", None, 1)],
        "i int, text string, task string, value int",
    )
    first = R.long_to_wide_unique(df, "text", "i")
    assert rows(first, "text", "x", "y") == [("a", 1, 0), ("b", 0, 0), ("c", 0, 0)]
    mean = R.long_to_wide_mean(df, "text")
    assert rows(mean, "text", "x", "y") == [("a", 1.0, 1.0), ("b", 0.0, 0.5)]
    with pytest.raises(Exception, match="duplicate rows for key b"):
        R.long_to_wide_keyed(df, ["text"]).collect()
    unique = df.where("i <> 4 and task is not null")
    wide = R.long_to_wide_keyed(unique, ["text"])
    assert rows(wide, "text", "x", "y") == [("a", 1, 1), ("b", 0, 0)]
    back = R.wide_to_long(wide, "text").where("value = 1")
    assert rows(back, "text", "task", "value") == [("a", "x", 1), ("a", "y", 1)]


def test_generated_rows(spark):
    df = spark.createDataFrame(
        [(1, ["t1", "t2"], ["a", "b"]), (2, ["t3"], []), (3, [], ["a"])],
        "i int, generated_comments array<string>, labels array<string>",
    )
    assert rows(R.product_rows(df, ["i"]), "i", "text", "target", "value") == [
        (1, "t1", "a", 1), (1, "t1", "b", 1), (1, "t2", "a", 1), (1, "t2", "b", 1), (2, "t3", None, 0)
    ]
    picked = df.withColumn("selected", C.first_k(F.col("generated_comments"), 1))
    assert rows(R.explode_generated(picked), "i", "text", "target") == [(1, "t1", "a"), (1, "t1", "b"), (2, "t3", None)]
    assert rows(R.explode_generated(picked, keep_empty=True), "i", "text")[-1] == (3, None)


def test_unmask_is_literal_and_ordered(spark):
    df = spark.createDataFrame([("N***UI n**ui b**t b$t",)], "t string")
    spellings = {"n***ui": "one", "n**ui": "two", "b**t": "$3"}
    assert df.select(C.unmask(F.col("t"), spellings)).first()[0] == "one two $3 b$t"


def test_answers(spark):
    good = 'x ```JSON [{"Index": 1, "index": null, "Original_Comment": "o", "labels": ["a"], "Generated_Comments": ["g"]}]\n``` ```json [] ```'
    df = spark.createDataFrame([(1, good), (2, "no fence"), (3, '```json [{"index": 1 ```'), (4, "```json [] ```")], "i int, answer string")
    records, rejects = GO.read_answers(df, keep=["i"])
    assert rows(records, "i", "index", "original_comment", "labels", "generated_comments") == [(1, 1, "o", ["a"], ["g"])]
    assert rows(rejects, "i") == [(2,), (3,)]
    assert rows(df.select("i", G.extract_fenced_json(F.col("answer")).alias("b")).where("i = 4"), "b") == [("[]",)]


def test_augment_train(spark):
    base = spark.createDataFrame([("x", "a", 0, "train"), ("y", "a", 1, "test")], "text string, task string, value int, split string")
    extra = spark.createDataFrame([("n1", "a"), ("n2", "z")], "text string, task string")
    merged, skipped = GO.augment_train(base, extra)
    assert rows(merged, "text", "task", "value", "split") == [("n1", "a", 1, "train"), ("x", "a", 0, "train"), ("y", "a", 1, "test")]
    assert rows(skipped, "task", "n") == [("z", 1)]


def test_prompt_batches(spark):
    df = spark.createDataFrame([(i * 10, f" t{i} ", "a,b") for i in range(7)], "i int, text string, labels string")
    batches = GO.prompt_batches(df, "i", 3).orderBy("batch").collect()
    assert [(r["batch"], r["n"], r["first_index"]) for r in batches] == [(0, 3, 0), (1, 3, 3), (2, 1, 6)]
    assert batches[2]["block"] == "Comment: t6\nIndex: 6\nLabels: a,b"


def test_prompt_batches_keep_rows_with_gaps(spark):
    df = spark.createDataFrame([(1, None, "l"), (2, "b", None), (1 << 60, "c", "m")], "i bigint, text string, labels string")
    row = GO.prompt_batches(df, "i", 3).first()
    assert row["n"] == 3 and row["block"].count("Comment:") == 3 and "Comment: \nIndex: 0" in row["block"]
