"""Exact dedup against groups made in plain Python."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from fixtures import corpus, edge_rows, frame
from labelspark.llm import exact


def plain(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for doc, text in rows:
        ids = [x for x in groups[text or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((doc, keep, len(groups[text or ""]), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_matches_plain_groups(spark):
    rows = edge_rows()
    assert found(exact.exact_duplicates(frame(spark, rows))) == plain(rows)


def test_chains_of_one_key(spark, monkeypatch):
    """All texts with one key: only the chain tells them apart."""
    whole = exact.keyed
    monkeypatch.setattr(exact, "keyed", lambda *a: whole(*a).withColumn("key", F.lit(7).cast("long")))
    rows = corpus(2, 20)
    assert found(exact.exact_duplicates(frame(spark, rows))) == plain(rows)


def test_directory_doubles(spark):
    rows = [(k, f"text {k}") for k in range(300)]
    index = exact.build_index(frame(spark, rows), capacity=5)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 5
    assert index.agg(F.max("local_depth")).first()[0] >= 6
    assert index.select("local_depth").distinct().count() > 1


def test_empty_table(spark):
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_drop_keeps_columns_and_one_of_each(spark):
    docs = frame(spark, corpus(3))
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    texts = [r[0] or "" for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in corpus(3)})


def test_normalised_texts(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    got = exact.exact_duplicates(frame(spark, rows), normalise=F.lower)
    assert {(r["doc_id"], r["keep_id"]) for r in got.collect()} == {(1, 2), (2, 2), (3, 3)}


def test_keys_of_many_rows_are_folded_in_shares(spark):
    rows = [(k, "copied") for k in range(40)] + [(100 + k, f"own {k % 7}") for k in range(14)] + [(None, "copied"), (5, "copied")]
    docs = frame(spark, rows)
    assert found(exact.exact_duplicates(docs, many=3)) == found(exact.exact_duplicates(docs)) == plain(rows)
    keyed = exact.keyed(docs, "doc_id", "text", None)
    entries = exact.folded(keyed, keyed.groupBy("key").agg(F.count("*").alias("n")), many=3)
    copies = entries.where("text = 'copied'")
    assert 1 < copies.count() <= exact.SHARES
    assert copies.agg(F.sum("group_size"), F.max("keep_id")).first() == (42, 39)
    assert entries.where("text <> 'copied'").count() == 14


def test_chains_of_one_folded_key(spark, monkeypatch):
    whole = exact.keyed
    monkeypatch.setattr(exact, "keyed", lambda *a: whole(*a).withColumn("key", F.lit(7).cast("long")))
    rows = corpus(4, 30)
    assert found(exact.exact_duplicates(frame(spark, rows), many=5)) == plain(rows)
    index = exact.build_index(frame(spark, rows), many=5)
    assert index.count() == len({t or "" for _, t in rows}) == index.agg(F.max("chain")).first()[0]


def test_texts_move_once(spark):
    """By page of the directory, sent or joined; nothing behind that moves them again."""
    rows = exact.keyed(frame(spark, corpus(1)), "doc_id", "text", None)
    pages, depth = exact.directory(rows.select("key").distinct(), 5)
    entries = rows.select("key", "text", F.col("doc_id").alias("keep_id"), F.lit(1).alias("group_size"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, moves in (("10m", 1), ("-1", 2)):  # the second one is the directory's
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            plan = exact.settled(entries, pages, depth)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(page") == moves
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_directory_leads_to_every_key(spark):
    rows = [(k, f"text {k}") for k in range(200)]
    index, pages, depth = exact.index_and_directory(frame(spark, rows), capacity=5)
    assert pages.agg(F.sum(F.size("cells"))).first()[0] <= 1 << depth
    keys = index.select("key", F.col("bucket").alias("own"), exact.page(depth, exact.cell(depth)).alias("page"))
    found_in = exact.in_buckets(keys, pages, depth)
    assert found_in.count() == 200 and not found_in.where("bucket <> own").count()


def test_one_bucket_is_joined_by_key(spark):
    """A directory of one cell is looked up like any other, without a cross join."""
    rows = [(1, "a"), (2, "a"), (3, None), (4, "b")]
    found = exact.exact_duplicates(frame(spark, rows))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found.collect()} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
