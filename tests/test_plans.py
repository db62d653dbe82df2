"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from labelspark.functions.clean import clean_text
from labelspark.operators import labels as L
from labelspark.operators import scores as S
from labelspark.operators import split as SP

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_cleaning_stays_in_the_jvm_and_reads_one_column(docs):
    text = plan(docs.select(clean_text(F.col("text")).alias("text")))
    assert "Python" not in text and "Exchange" not in text
    assert "ReadSchema: struct<text:string>" in text


def test_split_does_not_shuffle_rows(docs):
    split = SP.stratified_split(docs.select("doc_id", "text", "lang"), "doc_id", "lang", None)
    text = plan(split)
    assert "BroadcastHashJoin" in text and "Window" not in text and "SinglePartition" not in text
    assert "Exchange hashpartitioning" not in text


def test_class_map_lookup_is_broadcast(docs):
    tasks = docs.select("doc_id", "lang", "source").unpivot("doc_id", ["lang", "source"], "task", "value")
    text = plan(L.encode_labels(tasks, L.class_map(tasks)))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text


def test_scores_count_the_rows_once(docs):
    pred = docs.select(F.lit("t").alias("task"), (F.col("lang") == "en").cast("int").alias("actual"), F.lit(1).alias("predicted"))
    scores = S.scores_by_task(pred)
    scores.collect()
    text = plan(scores)
    final = text.split("== Initial Plan ==")[0]
    # both readers of the confusion counts share one exchange over the rows
    assert "ReusedExchange" in final


def test_grid_has_no_cross_join(docs):
    text = plan(L.complete_grid(docs.select("text", F.col("source").alias("target"))))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SMALL}/customer.parquet").where(F.col("c_acctbal") > 9990).select("c_custkey")
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,9990.0)]" in plan(rows)
