"""Files in the forms the readers expect, and texts that arrive in two batches."""

import json

from pyspark.sql import functions as F

from labelspark.functions import generated as G
from labelspark.functions.clean import clean_text
from labelspark.plans import build as B
from labelspark.plans import heads as H
from labelspark.sources import readers as R
from labelspark.sources import writers as W
from labelspark.streaming import scoring as ST


def test_file_list_and_levels(spark, tmp_path):
    positive, negative = "SET No. 1 a _ b+c_HS.v1.csv", "SET No. 1 a _ b+c_N.v1.csv"
    (tmp_path / positive).write_text('Comment;Target;HS Level\n"two\nlines; ""q""";x y;Level 2\nplain;;\n')
    (tmp_path / negative).write_text("Target;Comment\nx y;nice\n")
    files = [(positive, 1, "group"), (negative, 0, "group")]
    rows = {tuple(r) for r in R.read_file_list(spark, str(tmp_path), files).collect()}
    assert rows == {('two\nlines; "q"', "x y", 1, "group"), ("plain", None, 1, "group"), ("nice", "x y", 0, "group")}
    one = R.read_annotated_csv(spark, str(tmp_path / positive), label=1)
    assert one.columns == ["Comment", "Target", "Value"] and one.count() == 2
    leveled = R.read_levels_csv(spark, str(tmp_path), files).withColumn("id", F.monotonically_increasing_id())
    assert {(r["target"], r["level"]) for r in leveled.collect()} == {("x y", "Level 2"), (None, None), ("x y", None)}
    targets = leveled.unionByName(leveled).unionByName(leveled).unionByName(leveled)
    built = B.build_levels(targets, "id")
    assert {(r["task"], r["value"]) for r in built.collect()} == {("x-y#level", "x y Level 2"), ("x-y#level", "x y Level 0")}


def test_nested_json(spark, tmp_path):
    rows = [
        {"comment_id": "1", "content": "a", "found_manipulation": "yes", "annotations": [{"technique": "t"}, {"technique": "t"}]},
        {"comment_id": "2", "content": "b", "found_manipulation": "no", "annotations": None},
        {"comment_id": "3", "content": "c", "found_manipulation": "yes", "annotations": [{"technique": "u"}]},
    ]
    (tmp_path / "corpus.json").write_text(json.dumps(rows, indent=2))
    long = B.build_nested(R.read_annotation_json(spark, str(tmp_path / "corpus.json")))
    found = {(r["comment_id"], r["target"]) for r in long.where("value = 1").collect()}
    assert found == {("1", "Contains manipulation"), ("3", "Contains manipulation"), ("1", "t"), ("3", "u")}
    assert long.count() == 9


def test_generated_files(spark, tmp_path):
    (tmp_path / "index-0-2.json").write_text(json.dumps([{"Index": 4, "generated_comments": ["x"]}, {"index": 5, "Index": None}], indent=1))
    (tmp_path / "index-2-3.json").write_text(json.dumps([{"index": 6}]))
    (tmp_path / "broken.json").write_text('[{"index": 7')
    records = R.read_generated_json(spark, str(tmp_path)).select(G.coalesce_variants(F.col("record")).alias("r"))
    assert sorted(r[0]["index"] for r in records.collect()) == ["4", "5", "6"]


def test_task_partitions(spark, tmp_path):
    df = spark.createDataFrame([("007", "a", "train"), ("S,O/x=1", "b", "train"), ("007", "c", "test")], "task string, text string, split string")
    path = W.write_splits(df, str(tmp_path / "t"))
    assert {r["task"] for r in R.load_complete(spark, path).collect()} == {"007", "S,O/x=1"}
    assert R.load_task_split(spark, path, "007", "test").first()["text"] == "c"
    assert R.load_task_split(spark, path, "none", "test") is None
    assert R.load_task_split(spark, str(tmp_path / "missing"), "1", "test") is None
    W.replace_tasks(spark.createDataFrame([("007", "z", "test")], df.schema), path)
    assert {r["text"] for r in R.load_complete(spark, path).collect()} == {"a", "b", "z"}
    plan = R.load_all_tasks(spark, path, "test").where("task = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "task" in plan.split("PartitionFilters")[1].split("]")[0]


def test_report_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("dataset;model;target;accuracy;auc\nD;m1;a;0,5;NaN\n;;b;0,25;\n;m2;a;1;0,5\n")
    rows = R.read_report(spark, str(tmp_path / "r.csv"), ["accuracy", "auc"], ["dataset", "model"]).collect()
    assert [(r["dataset"], r["model"], r["target"], r["accuracy"]) for r in rows] == [("D", "m1", "a", 0.5), ("D", "m1", "b", 0.25), ("D", "m2", "a", 1.0)]
    assert rows[0]["auc"] != rows[0]["auc"] and rows[1]["auc"] is None and rows[2]["auc"] == 0.5


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    files = []
    for k in range(50):
        head = "Comment;Target;HS Level" if k % 2 else 'Target;"Comment"'
        (tmp_path / f"f {k}+.csv").write_text(f"{head}\n" + ("c;t;l\n" if k % 2 else "t;c\n"))
        files.append((f"f {k}+.csv", k % 2, f"g{k}"))
    spark.sparkContext.setJobGroup("headers", "headers")
    frame = R.read_levels_csv(spark, str(tmp_path), files)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("", "")
    # one for the lines, and what listing many files may take
    assert jobs <= 3
    found = sorted((r["group"], r["text"], r["target"], r["level"]) for r in frame.collect())
    assert found == sorted((f"g{k}", "c", "t", "l" if k % 2 else None) for k in range(50))


def test_a_header_of_two_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Comment;Target;"two\nlines"\nc;t;x\n')
    assert [tuple(r) for r in R.read_annotated_csv(spark, str(tmp_path / "a.csv")).collect()] == [("c", "t")]


def test_stream_of_a_folder_with_a_slash_and_of_one_file(spark, tmp_path):
    rows = spark.range(6)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    (part,) = (tmp_path / "in").glob("part-*.parquet")
    for k, path in enumerate((f"{tmp_path}/in/", f"{tmp_path}/in", str(part))):
        sink = ST.write_stream(ST.text_stream(spark, path, rows.schema), str(tmp_path / f"out{k}"), str(tmp_path / f"done{k}"))
        assert spark.read.parquet(sink).count() == 6


def test_stream_with_a_fitted_model_goes_on_after_a_restart(spark, tmp_path):
    texts = spark.createDataFrame([(i, "Good fine!!!!" if i % 2 else "Bad @you awful", i % 2) for i in range(40)], "i int, text string, value int")
    model, heads = H.train_heads_wide(texts.withColumn("text", clean_text(F.col("text"))), "i", ["value"], features=1 << 8)
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def score(rows):
        return H.predict_rows(rows, model, heads, ["i", "text"]).select("i", "text", F.col("idx").alias("predicted"))

    for low, high in ((0, 10), (10, 40)):
        texts.where(F.col("i").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
        ST.write_stream(ST.score_stream(ST.text_stream(spark, source, texts.schema), score), sink, progress)
        assert spark.read.parquet(sink).count() == high
    done = spark.read.parquet(sink)
    assert done.where(F.col("predicted") != F.col("i") % 2).count() == 0
    assert {r["text"] for r in done.select("text").distinct().collect()} == {"Good fine", "Bad awful"}
