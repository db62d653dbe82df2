"""Ranks, running sums and fills over sparse positions, and the files of written splits."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelspark.operators import ranks as K
from labelspark.operators import tokens as T
from labelspark.sources import writers as W


def sparse(n=400, seed=1):
    rng = random.Random(seed)
    return sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(n - 50)}) + list(range(1 << 62, (1 << 62) + 50))


@pytest.mark.parametrize("chunk", [16, K.CHUNK])
def test_index_of_sparse_ids(spark, chunk):
    ids = sparse()
    rows = K.row_index(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", chunk=chunk)
    assert {r["id"]: r["row_index"] for r in rows.collect()} == {i: k for k, i in enumerate(ids)}


def test_windows_of_sparse_ids_stay_small(spark):
    """No window without a partition key, so no task numbers all rows."""
    rows = K.row_index(spark.createDataFrame([(i,) for i in sparse()], "id bigint"), "id", chunk=16)
    assert "SinglePartition" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [16, K.CHUNK])
def test_running_sum_and_fill_of_sparse_positions(spark, chunk):
    ids = sparse()
    rng = random.Random(2)
    rows = [("a" if k % 3 else "b", i, rng.choice([None, None, None, f"v{k}"]), k % 5) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "g string, p bigint, c string, n bigint")
    summed = {(r["g"], r["p"]): r["s"] for r in K.running_sum(df, ["g"], "p", "n", "s", chunk).collect()}
    filled = {(r["g"], r["p"]): r["c"] for r in K.fill_down(df, ["g"], "p", ["c"], chunk).collect()}
    total, last = {}, {}
    for g, p, c, n in rows:
        total[g] = total.get(g, 0) + n
        last[g] = c if c is not None else last.get(g)
        assert summed[(g, p)] == total[g] and filled[(g, p)] == last[g]


def test_pieces_of_long_texts_go_by_chunks(spark):
    pieces = [("long", i, "x" if i % 4 == 0 else "##y", 1.0) for i in range(100)] + [("short", 0, "a", 2.0), ("short", 1, "##b", 3.0)]
    df = spark.createDataFrame(pieces, "doc string, pos int, token string, attribution double")
    plain = sorted(map(tuple, T.merge_wordpieces(df).collect()))
    assert sorted(map(tuple, T.merge_wordpieces(df, chunk=16).collect())) == plain and len(plain) == 26


def test_vocabulary_numbers_all_tokens(spark):
    df = spark.createDataFrame([("b a a c",), ("d a b",)], "text string")
    found = {r["token"]: r["token_id"] for r in T.vocabulary(df).collect()}
    assert found == {"a": 2, "b": 3, "c": 4, "d": 5}


def test_splits_have_bounded_files(spark, tmp_path):
    rows = spark.range(1000).repartition(8)
    rows = rows.select("id", F.concat(F.lit("t"), F.col("id") % 2).alias("task"), F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"))
    path = W.write_splits(rows, str(tmp_path / "few"))
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) == 4 and spark.read.parquet(path).count() == 1000
    path = W.write_splits(rows, str(tmp_path / "more"), rows_per_file=100)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert 4 <= len(files) <= 10 and spark.read.parquet(path).count() == 1000


def test_registered_cleaning_moves_no_text(spark):
    plan = entry.queries()["clean_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
