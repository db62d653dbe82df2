"""Tokens, word pieces, pooling, count heads, fitted heads, centroids, runs."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspark.functions import columns as C
from labelspark.operators import centroids as CE
from labelspark.operators import language as LG
from labelspark.operators import linear as LN
from labelspark.operators import report as R
from labelspark.operators import tiers as TI
from labelspark.operators import tokens as T
from labelspark.operators import descent as D
from labelspark.plans import evaluate as EV
from labelspark.plans import heads as H


def test_encode_pads_cuts_and_marks_unknown(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "b zz"), (3, "--")], "i int, text string")
    vocab = T.vocabulary(df.where("i = 1"), max_size=2)
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"a": 2, "b": 3}
    coded = {r["i"]: (r["input_ids"], r["attention_mask"]) for r in T.encode_tokens(df, vocab, "i", 3).collect()}
    assert coded == {1: ([2, 3, 2], [1, 1, 1]), 2: ([3, 1, 0], [1, 1, 0]), 3: ([0, 0, 0], [0, 0, 0])}


def test_wordpieces(spark):
    tokens = ["un", "##break", "##able", "#", "x", "y", "##z"]
    df = spark.createDataFrame([("d", i, t, float(s)) for i, (t, s) in enumerate(zip(tokens, [1, 5, 2, 3, 4, 1, 9]))], "doc string, pos int, token string, attribution double")
    words = T.merge_wordpieces(df).orderBy("word_no").collect()
    assert [(r["word"], r["attribution"]) for r in words] == [("unbreakable", 5), ("#", 3), ("x", 4), ("yz", 9)]


def test_pool(spark):
    df = spark.createDataFrame([("d", 0, [1.0, 2.0], 1), ("d", 1, [3.0, 4.0], 1), ("d", 2, [9.0, 9.0], 0)], "doc string, pos int, vector array<double>, mask int")
    assert [T.pool(df, "doc", m).first()["pooled"] for m in ("cls", "mean", "last")] == [[1, 2], [2, 3], [3, 4]]
    with pytest.raises(ValueError):
        T.pool(df, "doc", "max")


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 999.0],)], "l array<double>")
    row = df.select(C.softmax(F.col("l")).alias("p"), C.argmax(F.col("l")).alias("a")).first()
    assert row["a"] == 0 and sum(row["p"]) == pytest.approx(1) and row["p"][2] / row["p"][0] == pytest.approx(math.exp(-1))


def small_corpus(spark):
    rows = [(i, f"good fine w{i % 7}" if i % 2 else f"bad awful w{i % 5}", "mood", i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "i int, text string, task string, value int")


def test_count_heads_match_brute_force(spark):
    df = small_corpus(spark)
    terms = T.term_lists(df, "i")
    heads = LN.count_heads(terms, df.select("i", "task", F.col("value").alias("label")), "i")
    new = spark.createDataFrame([(1, "good good w1 unseen")], "i int, text string")
    row = LN.logits(T.term_lists(new, "i"), *heads, "i").first()
    found = dict(zip(row["labels"], row["logits"]))
    assert row["n_terms"] == 4
    words = {0: [], 1: []}
    for r in df.collect():
        words[r["value"]] += r["text"].split()
    size = len(set(words[0]) | set(words[1]))
    for label, own in words.items():
        expected = math.log(0.5) + sum(math.log((own.count(w) + 1) / (len(own) + size)) for w in "good good w1 unseen".split())
        assert found[label] == pytest.approx(expected)
    pred = LN.predict(T.term_lists(new, "i"), *heads, "i")
    assert pred.first()["predicted"] == 1
    parts = LN.attribute_tokens(T.term_lists(new, "i"), pred, *heads, "i").collect()
    assert sum(r["attribution"] ** 2 for r in parts) == pytest.approx(1)
    assert max(parts, key=lambda r: r["attribution"])["term"] == "good"


def plain_attributions(texts, predicted, weights, offsets):
    """{(id, task, predicted, term): attribution} from collected rows; rows of an id are one text."""
    counts, classes, heads, parts = {}, {}, {}, {}
    for i, terms in texts:
        for t in terms or []:
            counts.setdefault(i, Counter())[t] += 1
    for r in offsets:
        classes.setdefault(r["task"], {})[r["label"]] = r["floor"]
    for r in weights:
        heads.setdefault((r["term"], r["task"]), {})[r["label"]] = r["weight"]
    for i, task, label in {(r["i"], r["task"], r["predicted"]) for r in predicted if r["i"] is not None}:
        floors = classes[task]
        for term, n in counts.get(i, {}).items():
            shown = heads.get((term, task))
            if shown:
                pull = shown.get(label, 0) - sum(shown.values()) / len(floors) + floors[label] - sum(floors.values()) / len(floors)
                parts[i, task, label, term] = n * pull
    norms = Counter()
    for (i, task, _, _), a in parts.items():
        norms[i, task] += a * a
    return {key: a / math.sqrt(norms[key[:2]]) for key, a in parts.items()}


@pytest.mark.parametrize("bytes_sent", [1 << 24, 400])
def test_attributions_match_brute_force_without_a_row_per_term(spark, monkeypatch, bytes_sent):
    """Two tasks, null and repeated ids, texts without terms; with few bytes sent, rarer terms are joined. The terms stay in their text's row."""
    monkeypatch.setattr(TI, "SENT_BYTES", bytes_sent)
    rows = [(i, f"w{i % 11} w{i % 5} common x{i % 3}" + " again" * (i % 4), task, (i + len(task)) % (2 + (task == "b"))) for i in range(60) for task in ("a", "b") if i % 2 or task == "a"]
    df = spark.createDataFrame(rows, "i int, text string, task string, value int")
    heads = LN.count_heads(T.term_lists(df, "i"), df.select("i", "task", F.col("value").alias("label")), "i")
    new = [(1, "common w1 again again unseen"), (2, "w2 w3"), (2, "w2 x1 x1"), (2, "w2 w3"), (None, "common"), (4, ""), (5, None), (6, "unseen")]
    lists = T.term_lists(spark.createDataFrame(new, "i int, text string"), "i")
    pred = LN.predict(lists, *heads, "i")
    got = LN.attribute_tokens(lists, pred, *heads, "i").collect()
    want = plain_attributions([tuple(r) for r in lists.collect()], pred.collect(), *(h.collect() for h in heads))
    assert {tuple(r)[:4]: round(r["attribution"], 9) for r in got} == {k: round(a, 9) for k, a in want.items()} and len(got) == len(want) > 10
    top = LN.top_terms(LN.term_parts(lists, pred, *heads, "i"), "i", 2).collect()
    for key in {k[:2] for k in want}:
        best = sorted((-round(a, 9), k[3], k[2]) for k, a in want.items() if k[:2] == key)[:2]
        assert [(r["term"], r["predicted"]) for r in sorted((r for r in top if (r["i"], r["task"]) == key), key=lambda r: r["rank"])] == [b[1:] for b in best]
    if bytes_sent > 400:
        plan = LN.top_terms(LN.term_parts(lists, pred, *heads, "i"), "i", 2)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "explode(terms" not in plan


def test_the_parts_of_a_text_do_not_move(spark, monkeypatch):
    """Rare terms get their weights before anything is weighed: what is weighed is neither shuffled nor written."""
    monkeypatch.setattr(TI, "SENT_BYTES", 400)
    df = small_corpus(spark)
    lists = T.term_lists(df, "i")
    heads = LN.count_heads(lists, df.select("i", "task", F.col("value").alias("label")), "i")
    plan = LN.attribute_tokens(lists, LN.predict(lists, *heads, "i"), *heads, "i")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "_parts" in above and "hashpartitioning" not in above and "LeftOuter" not in above


def test_packed_terms_come_back(spark):
    rows = [(1, ["a", "b", "a", "東京", None]), (2, []), (3, None), (None, ["naïve"] * 300 + ["x" * 70_000])]
    packed = LN.packed_terms(spark.createDataFrame(rows, "i int, terms array<string>"), "i").toArrow()
    terms, n, sizes = LN.unpacked_terms(packed.column("_packed").combine_chunks())
    stops = np.cumsum(sizes)
    got = {i: dict(zip(terms.to_pylist()[b - k : b], n[b - k : b].tolist())) for i, k, b in zip(packed.column("i").to_pylist(), sizes, stops)}
    assert got == {i: dict(Counter(t for t in own or [] if t is not None)) for i, own in rows}


def test_many_classes_and_null_labels(spark):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(100)], "i int, text string")
    labels = docs.select("i", F.lit("t").alias("task"), F.when(F.col("i") > 0, F.col("i")).alias("label"))
    heads = LN.count_heads(T.term_lists(docs, "i"), labels, "i")
    found = {r["i"]: r["predicted"] for r in LN.predict(T.term_lists(docs, "i"), *heads, "i").collect()}
    assert found == {i: i or None for i in range(100)}
    blank = spark.createDataFrame([(1, None)], "i int, text string")
    assert LN.logits(T.term_lists(blank, "i"), *heads, "i").first()["n_terms"] == 0


def test_a_text_counts_once_whatever_its_tasks(spark):
    df = small_corpus(spark)
    two = df.unionByName(df.withColumn("task", F.lit("other")))
    heads = LN.count_heads(T.term_lists(df, "i"), two.select("i", "task", F.col("value").alias("label")), "i")
    one = spark.createDataFrame([(1, "mood", 1, "good w1")], "i int, task string, actual int, text string")
    both = one.unionByName(one.withColumn("task", F.lit("other")))
    terms = T.term_lists(both.select("i", "text").dropDuplicates(["i"]), "i")
    alone = LN.predict(T.term_lists(one, "i"), *heads, "i").where("task = 'mood'").first()["probs"]
    assert LN.predict(terms, *heads, "i").where("task = 'mood'").first()["probs"] == alone
    assert {r["task"]: r["accuracy"] for r in EV.cross_corpus_eval(both, heads, "i").collect()} == {"mood": 1.0, "other": 1.0}


def test_cross_corpus_ignores_missing_tasks(spark):
    df = small_corpus(spark)
    heads = LN.count_heads(T.term_lists(df, "i"), df.select("i", "task", F.col("value").alias("label")), "i")
    other = spark.createDataFrame([(1, "mood", 1, "good"), (2, "mood", 0, "awful"), (3, None, 1, "x"), (4, "else", 1, "good")], "i int, task string, actual int, text string")
    scores = EV.cross_corpus_eval(other, heads, "i").collect()
    assert [(r["task"], r["accuracy"]) for r in scores] == [("mood", 1.0)]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # copies of a text stay on one side, so a held-out text was never seen
    held_out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    found = LG.detect_language(docs.where(held_out), LG.language_profiles(docs.where(~held_out)), "doc_id")
    rows = found.join(docs, "doc_id").where("language is not null")
    assert rows.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.9
    blank = spark.createDataFrame([(1, "123 !")], "doc_id int, text string")
    profile = LG.language_profiles(spark.createDataFrame([("abc", "x")], "text string, lang string"))
    assert LG.detect_language(blank, profile, "doc_id").first()["language"] is None


def test_centroids_and_vectors_without_direction(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [0.0, 0.0], "c"), (4, [3.0, 1.0], None)], "i int, embedding array<double>, label string")
    found = {r["i"]: (r["predicted"], r["cosine"]) for r in CE.nearest_centroid(rows, CE.centroids(rows), "i").collect()}
    assert found[1] == ("a", 1.0) and found[2] == ("b", 1.0) and found[3] == ("a", None) and found[4][0] == "a"


def test_heads_wide_long_simple_and_sweep(spark):
    long = small_corpus(spark)
    one = long.where("value = 1").withColumn("task", F.lit("single"))
    tiny = long.where("i < 4").withColumn("task", F.lit("tiny"))
    every = long.unionByName(one).unionByName(tiny)
    model, heads, classes = H.train_heads_long(every, "i")
    pred = H.predict_long(every, model, heads, classes, "i")
    accuracy = {r["task"]: r["a"] for r in pred.groupBy("task").agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("a")).collect()}
    assert accuracy == {"mood": 1.0, "single": 1.0, "tiny": 1.0}
    wide = long.select("i", "text", F.col("value").alias("mood"), F.lit(1).alias("same"))
    model, heads = H.train_heads_wide(wide, "i", ["mood", "same"], features=1 << 8)
    assert list(heads) == ["mood"]
    assert H.predict_wide(wide, model, heads, "i").where("actual <> predicted").count() == 0
    _, _, scores = H.train_simple(wide, "i", "mood", features=1 << 8)
    assert scores.first()["accuracy"] == 1.0
    runs = H.sweep(wide.where("i % 2 = 0 or i % 3 = 0"), wide, "i", "mood", [0.01, 0.1], steps=(1, 2, 3, 4), patience=1, features=1 << 8).collect()
    assert sum(r["best"] for r in runs) == 1 and len(runs) < 8


def test_a_task_is_fitted_alike_alone_and_among_others(spark):
    long = small_corpus(spark)
    many = spark.range(10).crossJoin(long).drop("id")
    others = long.withColumn("task", F.lit("other")).withColumn("value", 1 - F.col("value"))

    def chances(df):
        model, heads, classes = H.train_heads_long(df, "i")
        rows = H.predict_long(long, model, heads, classes, "i").collect()
        return {r["i"]: round(r["probs"][1], 4) for r in rows}

    alone = chances(long)
    assert chances(long.unionByName(others)) == alone
    assert chances(many) == pytest.approx(alone, abs=0.02)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    return found


def test_jobs_do_not_grow_with_the_tasks(spark):
    long = small_corpus(spark)
    many = long.withColumn("task", F.explode(F.array(*[F.lit(f"t{k:02d}") for k in range(60)])))

    def fitted(df):
        model, heads, classes = H.train_heads_long(df, "i", max_iter=2, features=1 << 8)
        return H.predict_long(df, model, heads, classes, "i").collect()

    few = jobs_of(spark, "few heads", lambda: fitted(long))
    assert jobs_of(spark, "many heads", lambda: fitted(many)) <= few
    rows = fitted(many)
    assert len(rows) == 60 * long.count() and len({r["task"] for r in rows}) == 60


def test_texts_are_cleaned_once_for_all_tasks(spark):
    long = small_corpus(spark)
    many = long.withColumn("task", F.explode(F.array(*[F.lit(f"t{k:02d}") for k in range(60)])))
    model, heads, classes = H.train_heads_long(long.withColumn("task", F.lit("t00")), "i", max_iter=1, features=1 << 8)
    plan = H.predict_long(many, model, heads, classes, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_heads_in_groups_are_those_of_one_group(spark, monkeypatch):
    long = small_corpus(spark)
    two = long.unionByName(long.withColumn("task", F.lit("other")).withColumn("value", 1 - F.col("value")))
    _, whole, _ = H.train_heads_long(two, "i", max_iter=4, features=1 << 8)
    monkeypatch.setattr(D, "HEAD_BYTES", 1)
    _, cut, _ = H.train_heads_long(two, "i", max_iter=4, features=1 << 8)
    assert list(cut) == list(whole) and cut.weights == pytest.approx(whole.weights)


def test_steps_follow_a_plain_gradient(spark):
    """Two steps of the fit against the same arithmetic on dense arrays."""
    rows = [("a b", 0), ("b c c", 1), ("a", 0), ("a", 1), ("a", 0), ("d e f", 1)]
    df = spark.createDataFrame([(i, text, "t", y) for i, (text, y) in enumerate(rows)], "i int, text string, task string, value int")
    size = 1 << 6
    model, heads, _ = H.train_heads_long(df, "i", max_iter=2, reg=0.01, features=size)
    listed = df.select(D.word_list(size, lambda c: c).alias("w")).collect()
    docs = [set(r["w"]) for r in {r["text"]: r for r in df.select("text", D.word_list(size, lambda c: c).alias("w")).collect()}.values()]
    idf = np.array([np.log((len(docs) + 1) / (sum(k in d for d in docs) + 1)) + 1 if any(k in d for d in docs) else 0 for k in range(size)])
    assert model.idf == pytest.approx(idf)
    x = np.zeros((len(rows), size + 1))
    for k, r in enumerate(listed):
        for w in r["w"]:
            x[k, w] += idf[w]
        x[k] /= np.linalg.norm(x[k])
        x[k, size] = 1
    y = np.array([label for _, label in rows])
    share = np.array([len(y) / (2 * (y == label).sum()) for label in y])
    w, m, v = np.zeros((size + 1, 2)), 0, 0
    for step in (1, 2):
        e = np.exp(x @ w)
        p = e / e.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ (p * share[:, None]) / share.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = w - H.RATE * (move + 0.01 * w * (np.arange(size + 1) < size)[:, None])
    assert heads.weights == pytest.approx(w, abs=1e-3)


def test_a_head_keeps_its_best_step_and_stops(spark):
    long = small_corpus(spark)
    wrong = long.withColumn("value", 1 - F.col("value"))
    _, heads, _ = H.train_heads_long(long, "i", max_iter=20, features=1 << 8, valid=wrong, patience=2)
    steps = [step for _, step, _ in heads.history]
    assert steps == [1, 2, 3] and max(a for _, _, a in heads.history) == heads.history[0][2]
    _, heads, _ = H.train_heads_long(long, "i", max_iter=4, features=1 << 8, valid=long, patience=9)
    assert [step for _, step, _ in heads.history] == [1, 2, 3, 4] and heads.history[-1][2] == 1.0


def test_rare_terms_are_joined_with_the_same_sums(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    terms = T.term_lists(docs, "doc_id")
    heads = LN.count_heads(terms, docs.select("doc_id", F.lit("t").alias("task"), F.col("lang").alias("label")), "doc_id")
    told = lambda: {(r["doc_id"], r["task"]): (r["n_terms"], r["logits"]) for r in LN.logits(terms, *heads, "doc_id").collect()}
    whole = told()
    monkeypatch.setattr(TI, "SENT_BYTES", 200 * (TI.TERM_BYTES + 32))
    monkeypatch.setattr(TI, "CELLS", 64)
    cut = told()
    assert set(cut) == set(whole)
    for key, (n, sums) in whole.items():
        assert cut[key][0] == n and cut[key][1] == pytest.approx(sums)
    few = spark.createDataFrame([(1, ["known", None, "new"]), (2, []), (3, None)], "i int, terms array<string>")
    weights = spark.createDataFrame([("known", 0, 2.0), ("rare", 1, 1.0)], "term string, idx int, weight double")
    monkeypatch.setattr(TI, "SENT_BYTES", 1)
    found = TI.tiers(weights, 2)
    assert len(found.terms) == 1 and found.rare.count() == 1
    assert {r["i"]: (r["n_terms"], r["sums"]) for r in TI.term_sums(few, found, "i", "terms").collect()} == {1: (2, [2.0, 0.0]), 2: (0, [0, 0]), 3: (0, [0, 0])}


def test_frequent_terms_need_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = LG.language_profiles(docs)
    plan = LG.detect_language(docs, profiles, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0] and "Join" not in plan.split("Subquery")[0]
    plan = T.encode_tokens(docs, T.vocabulary(docs), "doc_id", 64)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_trigrams_are_those_of_the_pattern():
    texts = [" ab ", "  ", "", None, " é東 𝔘𝔘 ", " x "]
    codes, sizes = LG.trigram_codes(pa.array(texts))
    every = [x[k : k + 3] for x in texts if x for k in range(len(x) - 2)]
    assert codes.to_pylist() == [ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in every]
    assert sizes.tolist() == [max(len(x or "") - 2, 0) for x in texts]


def test_rare_tokens_are_joined_with_the_same_ids(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab = T.vocabulary(docs)
    coded = lambda df: {r["doc_id"]: r["input_ids"] for r in T.encode_tokens(df, vocab, "doc_id", 40).collect()}
    odd = spark.createDataFrame([(-1, None), (-2, "unseenword the"), (-3, "")], "doc_id long, text string")
    whole = coded(docs.select("doc_id", "text").unionByName(odd))
    monkeypatch.setattr(T, "SENT_TOKENS", 30)
    assert coded(docs.select("doc_id", "text").unionByName(odd)) == whole and whole[-1] == [0] * 40


def test_best_and_compared_runs(spark):
    nan = float("nan")
    df = spark.createDataFrame([("o", "m1", "t", 0.5), ("o", "m2", "t", 0.5), ("o", "m0", "t", nan), ("a", "m1", "t", 0.7)], "dataset string, model string, target string, accuracy double")
    assert {(r["dataset"], r["model"]) for r in R.best_runs(df).collect()} == {("o", "m1"), ("a", "m1")}
    gains = {r["model"]: r["gain"] for r in R.compare_runs(df, "o", "a").collect()}
    assert gains["m1"] == pytest.approx(0.2) and gains["m2"] is None


def test_what_is_sent_of_a_large_vocabulary_is_small(spark, monkeypatch):
    """Few tokens and weights lie in every Python worker, however many there are; the others are joined, with the same results."""
    sent, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: (sent.append(value), real(value))[1])
    vocab = spark.range(400_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 2).cast("int").alias("token_id"))
    df = spark.createDataFrame([(1, "w0 w399999 w200000 none")], "i int, text string")
    assert T.encode_tokens(df, vocab, "i", 4).first()["input_ids"] == [2, 400_001, 200_002, 1]
    assert len(sent[-1][0]) <= 1 << 17
    found = TI.tiers(vocab.select(F.col("token").alias("term"), F.lit(0).alias("idx"), F.col("token_id").cast("double").alias("weight")), 1)
    assert found.weights.nbytes + TI.TERM_BYTES * len(found.terms) <= (1 << 24) + 64 and found.rare is not None
    row = TI.term_sums(T.term_lists(df, "i"), found, "i", "terms").first()
    assert row["n_terms"] == 4 and row["sums"] == [2 + 400_001 + 200_002]


def test_one_block_is_open_at_a_time():
    """A batch of many blocks is read in place; texts come to a block a few at a time."""
    cells = np.ones(1 << 17, "<f4").tobytes()
    own = {"places": np.zeros(1 << 17, "<i4").tobytes(), "cells": cells, "columns": np.zeros(1, "<i4").tobytes(), "ends": np.array([1 << 17], "<i4").tobytes()}
    names = [x.split()[0] for x in D.BLOCKS.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array([own.get(name, b"")] * 40, pa.binary()) for name in names], names=names)
    tracemalloc.start()
    assert sum(dense.shape == (1, 1) for _, dense, _ in D.opened(batch)) == 40
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(cells)
    parts = [p.column(0).to_pylist() for p in D.evened([pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 11))], 4)]
    assert parts == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]


def test_small_batches_hold_while_a_job_runs(spark):
    from labelspark.session import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    rows = spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    with small_batches(spark, 16):
        assert max(r["n"] for r in rows.collect()) <= 16
    assert spark.conf.get(name) == usual
