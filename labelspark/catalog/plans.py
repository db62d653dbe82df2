"""End-to-end plans: dataset builds, fitted heads, arriving texts."""

from pyspark.sql import Window as W, functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog import sql_text as S
from labelspark.catalog.files import _write_json_arrays
from labelspark.catalog.registry import query
from labelspark.catalog.splitting import RANKED
from labelspark.operators import labels as L
from labelspark.functions.generated import coalesce_variants
from labelspark.operators import generated as GO
from labelspark.operators import split as SP
from labelspark.plans import build as B
from labelspark.plans import heads as H
from labelspark.operators.reshape import wide_to_long
from labelspark.session import shared_folder
from labelspark.sources import readers as RD
from labelspark.streaming import scoring as ST

GRID = f"""
{I.COMMENTS},
grid as (select t.text, s.target as task from (select distinct text from comments) t cross join (select distinct target from comments) s),
known as (select text, target as task, max_by(value, doc_id) as value from comments where value <> 0 group by text, target),
filled as (select md5(g.text) as doc_id, g.task, coalesce(k.value, 0) as value from grid g left join known k using (text, task)),
counted as (select task, value, count(*) as n from filled group by all),
good as (select task from counted group by task having min(least(floor(n * 0.7), n - floor(n * 0.7))) >= 2),
ranked as (select f.*, row_number() over (partition by task, value order by md5(concat(doc_id, '-42'))) as r,
                  count(*) over (partition by task, value) as n from filled f join good using (task))
"""


@query(
    "build_long",
    f"""with {GRID} select doc_id, task, value,
    case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split from ranked""",
)
def build_long(read, spark):
    return B.build_long(I.comments(read), "doc_id", complete=True)[0].select("doc_id", "task", "value", "split")


@query(
    "build_levels",
    "select doc_id, source || '#level' as task, source || ' ' || case when lang = 'en' then 'Level 0' else 'Level ' || lang end as value from documents",
)
def build_levels(read, spark):
    level = F.when(F.col("lang") != "en", F.concat(F.lit("Level "), F.col("lang")))
    rows = read("documents").select("doc_id", "text", F.col("source").alias("target"), level.alias("level"))
    return B.build_levels(rows, "doc_id").select("doc_id", "task", "value")


@query(
    "build_wide",
    f"""with {I.COMMENTS}, firsts as (select *, row_number() over (partition by text order by doc_id) as r from comments)
    select md5(text) as text_md5, {", ".join(f"max(case when target = 'src{i}' then value else 0 end) as src{i}" for i in range(20))}
    from firsts where r = 1 group by text""",
)
def build_wide(read, spark):
    wide = B.build_wide(I.comments(read), "doc_id")
    return wide.select(F.md5("text").alias("text_md5"), *[c for c in wide.columns if c != "text"])


@query(
    "build_votes",
    f"""with {I.ANNOTATIONS},
    flags as (select comment_id, text,
        2 * sum(target_flag_a::integer) > count(*) as a, 2 * sum(target_flag_r::integer) > count(*) as r,
        2 * sum(target_status_o::integer) > count(*) as o, 2 * sum(target_size::integer) > count(*) as s
        from annotations group by comment_id, text),
    best as (select comment_id, hatespeech, row_number() over (partition by comment_id order by count(*) desc, hatespeech) as k
             from annotations group by comment_id, hatespeech)
    select comment_id, text, hatespeech, cast(a or r as integer) as flag, cast(s as integer) as size, cast(o as integer) as status,
           cast(a or r or o or s as integer) as contains_hate
    from flags join best using (comment_id) where k = 1""",
)
def build_votes(read, spark):
    return B.build_votes(I.annotations(read), "comment_id", I.ANNOTATION_FLAGS, "hatespeech")


VOTES = f"""
{I.ANNOTATIONS},
flags as (select comment_id, text,
    2 * sum(target_flag_a::integer) > count(*) as a, 2 * sum(target_flag_r::integer) > count(*) as r,
    2 * sum(target_status_o::integer) > count(*) as o, 2 * sum(target_size::integer) > count(*) as s
    from annotations group by comment_id, text),
voted as (
  select comment_id as doc_id, text, 'flag' as task, cast(a or r as integer) as value from flags
  union all select comment_id, text, 'size', cast(s as integer) from flags
  union all select comment_id, text, 'status', cast(o as integer) from flags
  union all select comment_id, text, 'contains_hate', cast(a or r or o or s as integer) from flags
  union all select p_partkey, p_name, 'flag', 1 from part),
vote_counts as (select task, value, count(*) as n from voted group by all),
good_votes as (select task from vote_counts group by task having min(least(floor(n * 0.7), n - floor(n * 0.7))) >= 2),
ranked_votes as (select v.*, row_number() over (partition by task, value order by md5(concat(cast(doc_id as varchar), '-42'))) as r,
                        count(*) over (partition by task, value) as n from voted v join good_votes using (task))"""


@query(
    "written_votes",
    f"""with {VOTES} select count(*) as rows, task, value,
    case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split
    from ranked_votes group by all""",
)
def written_votes(read, spark):
    """Annotations to task and split directories, read again: rows per task, class and split."""
    extra = read("part").select(F.col("p_partkey").alias("comment_id"), F.col("p_name").alias("text"), F.lit("flag").alias("task"), F.lit(1).alias("value"))
    path, _ = B.written_votes(I.annotations(read), "comment_id", I.ANNOTATION_FLAGS, "hatespeech", shared_folder(spark, "votes"), extra=extra)
    return RD.load_complete(spark, path).groupBy("task", "value", "split").agg(F.count(F.lit(1)).alias("rows"))


WIDE_TASKS = [f"src{i}" for i in range(20)]


@query(
    "written_wide",
    f"""with {I.COMMENTS}, firsts as (select *, row_number() over (partition by text order by doc_id) as r from comments),
    wide_rows as (select md5(text) as text_md5, {", ".join(f"max(case when target = '{t}' then value else 0 end) as {t}" for t in WIDE_TASKS)}
                  from firsts where r = 1 group by text),
    placed as (select *, row_number() over (order by md5(concat(text_md5, '-42'))) as r, count(*) over () as n from wide_rows)
    select text_md5, {", ".join(WIDE_TASKS)},
           case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split from placed""",
)
def written_wide(read, spark):
    """Comments to a wide table with one row per text, split at random, written and read again."""
    path = B.written_wide(I.comments(read), "doc_id", shared_folder(spark, "wide-splits"), WIDE_TASKS)
    return spark.read.parquet(path).drop("text")


@query(
    "generated_chain",
    f"""with {RANKED},
    sources as (select distinct text, lang from documents),
    generated as (select b.item_id, s.lang from benchmark b join documents d on d.doc_id % 40 = b.item_id % 40 join sources s on s.text = d.text),
    chosen as (select g.lang as task, unnest(['one ' || g.item_id, 'two ' || g.item_id]) as text from generated g),
    relabelled as (select c.text, case s when 'en' then 'toxic' when 'de' then 'quality' else s end as task
                   from (select text, unnest([task, 'extra']) as s from chosen) c)
    select task, split, count(*) as n from (
      select task, split from splits
      union all select task, 'train' from relabelled where task in ('toxic', 'quality'))
    group by all""",
)
def generated_chain(read, spark):
    """Generator files with field names in any case: read, settled, labelled by their source, cut, unfolded, renamed, into the train split."""
    docs = read("documents").select("doc_id", "text", "lang")
    asked = read("benchmark").select("item_id").join(docs, F.expr("doc_id % 40 = item_id % 40"))
    answers = F.array(*[F.concat(F.lit(f"{w} "), F.col("item_id").cast("string")) for w in ("one", "two", "three")])
    records = asked.select(F.col("doc_id").alias("INDEX"), F.col("text").alias("Original_Comment"), answers.alias("generated_Comments"))
    files = _write_json_arrays(records, "INDEX", shared_folder(spark, "generated"), 25)
    settled = RD.read_generated_json(spark, files).select(coalesce_variants(F.col("record")).alias("r"))
    fields = settled.select(F.col("r")["original_comment"].alias("original_comment"), F.col("r")["generated_comments"].alias("generated_comments"))
    labelled = docs.select("text", F.array("lang", F.lit("extra")).alias("labels")).dropDuplicates(["text", "labels"])
    names = spark.createDataFrame([("en", "toxic"), ("de", "quality")], "task string, base_task string")
    extra = B.generated_rows(fields, labelled, names)
    base = SP.stratified_split(I.long(read), "doc_id")
    rows, _ = GO.augment_train(base, extra.withColumn("doc_id", F.lit(None).cast("bigint")))
    return rows.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "build_nested",
    f"""with {I.CORPUS}
    select comment_id, md5(content) as text_md5, 'Contains manipulation' as target, cast(found as integer) as value from corpus
    union all select c.comment_id, md5(c.content), t.target, cast(list_contains(c.types, t.target) as integer)
    from corpus c cross join (select distinct unnest(types) as target from corpus) t""",
)
def build_nested(read, spark):
    return B.build_nested(I.corpus(read)).select("comment_id", F.md5("text").alias("text_md5"), "target", "value")


@query(
    "build_suite",
    """select md5(text) as text_md5, case lang when 'en' then 'origin' else 'race' end as task, 1 as value from documents where lang in ('en', 'de', 'fr')
    union all select md5(text), 'contains_hate', cast(source = 'src1' as integer) from documents""",
)
def build_suite(read, spark):
    cases = read("documents").select(
        F.col("text").alias("test_case"), F.col("lang").alias("target_ident"), F.col("source").alias("label_gold")
    )
    rows = B.build_suite(cases, {"en": "origin", "de": "race", "fr": "race"}, "src1")
    return rows.select(F.md5("text").alias("text_md5"), "task", "value")


def _labelled(read):
    return I.wide(read).select("doc_id", "text", "quality", "toxic")


def _facts(pred, classes):
    """What must hold of any head's predictions: (task, actual, n, n_known, n_sums).

    Rows per task and actual class, how many of them got a class of the task's class map, and how many a probability per
    class that sum to 1.
    """
    k = classes.groupBy("task").agg(F.collect_set("value").alias("_k"))
    rows = pred.join(F.broadcast(k), "task")
    whole = F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    sums = whole & (F.size("probs") == F.size("_k")) & F.forall("probs", lambda x: (x >= 0) & (x <= 1))
    return rows.groupBy("task", "actual").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("_k", F.col("predicted"))).alias("n_known"), F.count_if(sums).alias("n_sums")
    )


def _facts_sql(rows, tasks):
    return f"select task, value as actual, count(*) as n, count(*) as n_known, count(*) as n_sums from {rows} where task in ({tasks}) and split = 'test' group by all"


RANDOM = """
half as (select *, row_number() over (order by md5(concat(doc_id, '-42'))) as r, count(*) over () as n from documents join labels using (doc_id)),
random_rows as (select *, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.85) then 'validation' else 'test' end as split from half),
random_long as (select doc_id, 'quality' as task, quality as value, split from random_rows union all select doc_id, 'toxic', toxic, split from random_rows),
both_classes as (select task from random_long where split = 'train' group by task having count(distinct value) > 1)"""


TRAINED = "select task from splits where split = 'train'"


@query("train_heads_wide", f"with {RANDOM} {_facts_sql('random_long', 'select task from both_classes')}")
def train_heads_wide(read, spark):
    """Facts of the test predictions of a head per label column."""
    rows = SP.random_split(_labelled(read), "doc_id")
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    model, heads = H.train_heads_wide(train, "doc_id", ["quality", "toxic"], max_iter=10)
    classes = L.class_map(wide_to_long(train.select("quality", "toxic"), [], ["quality", "toxic"]))
    return _facts(H.predict_wide(test, model, heads, "doc_id"), classes)


@query("train_heads_long", f"with {RANKED} {_facts_sql('splits', TRAINED)}")
def train_heads_long(read, spark):
    """Facts of the test predictions of a head per task of a long table."""
    rows = SP.stratified_split(I.long_text(read).select("doc_id", "text", "task", "value"), "doc_id")
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    model, heads, classes = H.train_heads_long(train, "doc_id", max_iter=10)
    return _facts(H.predict_long(test, model, heads, classes, "doc_id"), classes)


@query(
    "train_simple",
    "select 'quality' as task, true as accuracy, true as f1_score, true as kappa, true as roc_auc",
)
def train_simple(read, spark):
    """Whether the scores of a single head lie where such scores can lie."""
    scores = H.train_simple(_labelled(read), "doc_id", "quality", max_iter=10)[2]
    share = lambda c: F.col(c).between(0, 1).alias(c)
    return scores.select("task", share("accuracy"), share("f1_score"), F.col("kappa").between(-1, 1).alias("kappa"), share("roc_auc"))


@query(
    "sweep",
    "select unnest([0.001::double, 0.1::double]) as reg, true as in_order, true as shares, 1 as n_best",
)
def sweep(read, spark):
    """Per regularisation whether its runs grow in iterations and give shares; the best run of all is one."""
    rows = SP.random_split(_labelled(read), "doc_id")
    train, valid = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "validation")
    runs = H.sweep(train, valid, "doc_id", "quality", regs=[0.001, 0.1], steps=(2, 5, 10), patience=1)
    # a row per fitted setting: few
    every = runs.withColumn("_best", F.sum(F.col("best").cast("int")).over(W.partitionBy(F.lit(0))))
    steps = F.array_sort(F.collect_list("max_iter"))
    return every.groupBy("reg").agg(
        (steps == F.slice(F.array(F.lit(2), F.lit(5), F.lit(10)), F.lit(1), F.size(steps))).alias("in_order"),
        F.bool_and(F.col("accuracy").between(0, 1)).alias("shares"),
        F.max("_best").cast("int").alias("n_best"),
    )


@query(
    "score_stream",
    f"select doc_id, cast(contains({S.clean_text('text')}, '***') as integer) as predicted, length({S.clean_text('text')}) as n from documents",
)
def score_stream(read, spark):
    """Documents as arriving files, scored by a keyword rule."""
    stream = ST.text_stream(spark, read.path("documents"), read("documents").schema)
    rule = F.contains("text", F.lit("***")).cast("int").alias("predicted")
    scored = ST.score_stream(stream, lambda rows: rows.select("doc_id", rule, F.length("text").cast("bigint").alias("n")))
    path = shared_folder(spark, "scored")
    return spark.read.parquet(ST.write_stream(scored, path, f"{path}-progress"))
