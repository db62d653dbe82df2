"""Scores and losses of rule predictions over whole tables."""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog import sql_text as T
from labelspark.catalog.registry import query
from labelspark.catalog.splitting import RANKED
from labelspark.functions import columns as C
from labelspark.functions.clean import clean_text
from labelspark.operators import labels as L
from labelspark.operators import report as R
from labelspark.operators import scores as S
from labelspark.operators import split as SP
from labelspark.session import written

SCORES = ["accuracy", "f1_score", "precision", "recall", "kappa", "roc_auc"]


def predictions(read):
    """Rule predictions for three tasks: two classes, four classes, and one class only."""
    docs = read("documents")
    stars = F.contains("text", F.lit("***")).cast("int")
    # the flag, not the text, meets the labels
    flags = docs.select("doc_id", stars.alias("predicted"))
    labelled = I.long(read).join(flags, "doc_id").select("task", F.col("value").alias("actual"), "predicted")
    guess = (
        F.when(F.contains("text", F.lit(" the ")), 0)
        .when(F.contains("text", F.lit(" und ")), 1)
        .when(F.contains("text", F.lit(" les ")), 2)
        .otherwise(3)
    )
    actual = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    langs = docs.select(F.lit("lang").alias("task"), actual.alias("actual"), guess.alias("predicted"))
    sure = docs.select(F.lit("any").alias("task"), F.lit(1).alias("actual"), (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return labelled.unionByName(langs).unionByName(sure)


PREDICTIONS = f"""
{I.LONG_TEXT},
predictions as (
  select task, value as actual, cast(contains(text, '***') as integer) as predicted from long_text
  union all
  select 'lang', case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 else 3 end,
         case when contains(text, ' the ') then 0 when contains(text, ' und ') then 1 when contains(text, ' les ') then 2 else 3 end
  from documents
  union all
  select 'any', 1, cast(n_chars > 500 as integer) from documents
)"""

SCORED = """
confusion as (select task, actual, predicted, count(*) as n from {source} group by all),
marks as (
  select task, label, sum(a) as a, sum(p) as p, sum(t) as t from (
    select task, actual as label, n as a, 0 as p, case when actual = predicted then n else 0 end as t from confusion
    union all select task, predicted, 0, n, 0 from confusion) group by task, label),
sums as (
  select task, sum(a) as n, sum(t) as hits, sum(a * p) / (sum(a)::double * sum(a)) as pe, count(*) filter (a > 0) as k,
         coalesce(sum(a) filter (label = {pos}), 0) as pa, coalesce(sum(p) filter (label = {pos}), 0) as pp,
         coalesce(sum(t) filter (label = {pos}), 0) as pt
  from marks group by task),
pairs as (
  select x.task, sum(x.n * y.n * case when x.predicted > y.predicted then 1.0 when x.predicted = y.predicted then 0.5 else 0 end)
         / sum(x.n * y.n) as auc
  from confusion x join confusion y on x.task = y.task and x.actual > y.actual group by x.task),
parts as (
  select s.task, hits / n as accuracy, pe, case when k = 2 then case when pp = 0 then 0 else pt / pp end else hits / n end as precision,
         case when k = 2 then case when pa = 0 then 0 else pt / pa end else hits / n end as recall,
         case when k = 2 then auc else 'nan'::double end as roc_auc
  from sums s left join pairs using (task)),
scores as (
  select task, round(accuracy, 6) as accuracy,
         round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1_score,
         round(precision, 6) as precision, round(recall, 6) as recall,
         round(case when pe = 1 then 'nan'::double else (accuracy - pe) / (1 - pe) end, 6) as kappa, round(roc_auc, 6) as roc_auc
  from parts)"""


def scored(source="predictions", pos=1):
    return SCORED.format(source=source, pos=pos)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in SCORES or c == "loss" else F.col(c) for c in df.columns])


@query("confusion", f"with {PREDICTIONS} select task, actual, predicted, count(*) as n from predictions group by all")
def confusion(read, spark):
    return S.confusion(predictions(read))


def _one_score(name, columns):
    @query(name, f"with {PREDICTIONS}, {scored()} select task, {', '.join(columns)} from scores")
    def run(read, spark):
        return rounded(S.scores_by_task(predictions(read))).select("task", *columns)


_one_score("accuracy", ["accuracy"])
_one_score("kappa", ["kappa"])
_one_score("roc_auc_hard", ["roc_auc"])
_one_score("scores_by_task", SCORES)


@query(
    "precision_recall_f1_binary",
    f"with {PREDICTIONS}, two as (select * from predictions where task in ('quality', 'toxic')), {scored('two', 0)} select task, precision, recall, f1_score from scores",
)
def precision_recall_f1_binary(read, spark):
    two = predictions(read).where(F.col("task").isin("quality", "toxic"))
    return rounded(S.scores_by_task(two, pos_label=0)).select("task", "precision", "recall", "f1_score")


@query(
    "precision_recall_f1_micro",
    f"with {PREDICTIONS} select task, round(avg(cast(actual = predicted as integer)), 6) as precision, round(avg(cast(actual = predicted as integer)), 6) as recall, round(avg(cast(actual = predicted as integer)), 6) as f1_score from predictions where task = 'lang' group by task",
)
def precision_recall_f1_micro(read, spark):
    many = predictions(read).where(F.col("task") == "lang")
    return rounded(S.scores_by_task(many)).select("task", "precision", "recall", "f1_score")


@query(
    "scores_by_model_classes",
    f"with {PREDICTIONS}, {scored()} select task, case when task in ('quality', 'toxic') then precision else accuracy end as precision, kappa from scores",
)
def scores_by_model_classes(read, spark):
    pred = predictions(read)
    classes = L.class_map(pred.where(F.col("task") != "any"), label="actual").groupBy("task").agg(F.count(F.lit(1)).alias("n_classes"))
    return rounded(S.scores_by_task(pred, model_classes=classes)).select("task", "precision", "kappa")


@query(
    "mean_over_tasks",
    f"with {PREDICTIONS}, {scored()} select "
    + ", ".join(f"round(avg(case when isnan({c}) then null else {c} end), 5) as {c}" for c in SCORES)
    + " from scores",
)
def mean_over_tasks(read, spark):
    mean = S.mean_over_tasks(rounded(S.scores_by_task(predictions(read))))
    return mean.select(*[F.round(c, 5).alias(c) for c in SCORES])


REPORT = f"""
with {PREDICTIONS}, {scored()},
rows as (
  select task, cast(label as varchar) as label, case when p = 0 then 0 else t / p end as precision,
         case when a = 0 then 0 else t / a end as recall, a as support, t from marks),
full_rows as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1_score from rows),
report as (
  select task, label, precision, recall, f1_score, support from full_rows
  union all select task, 'accuracy', sum(t) / sum(support), sum(t) / sum(support), sum(t) / sum(support), sum(support) from full_rows group by task
  union all select task, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) from full_rows group by task
  union all select task, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), sum(support) from full_rows group by task)
select task, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score, cast(support as bigint) as support from report
"""


@query("classification_report", REPORT)
def classification_report(read, spark):
    return rounded(S.classification_report(predictions(read)))


def probabilities(read):
    """Two probabilities per labelled document from its length, and one per value of every vector, its label the class."""
    p = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    chances = read("documents").select("doc_id", F.array(1 - p, p).alias("probs"))
    docs = I.long(read).join(chances, "doc_id").select("task", F.col("value").alias("actual"), "probs")
    vectors = read("embeddings").select(
        F.lit("vector").alias("task"),
        F.col("label").cast("int").alias("actual"),
        C.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("probs"),
    )
    return docs.unionByName(vectors)


PROBABILITIES = f"""
{I.LONG_TEXT},
probabilities as (
  select task, value as actual, case when value = 1 then n_chars / (n_chars + 2000.0::double) else 1 - n_chars / (n_chars + 2000.0::double) end as p from long_text
  union all
  select 'vector', cast(label as integer),
         exp(embedding[cast(label as integer) + 1]::double) / list_sum(list_transform(embedding, lambda x: exp(x::double))) from embeddings
),
weights as (select task, actual, sum(count(*)) over (partition by task) / (count(*) over (partition by task) * count(*)) as w
            from probabilities group by task, actual),
weighted as (select * from probabilities join weights using (task, actual))"""


def _weights(pred):
    return L.class_weights(pred, label="actual").withColumnRenamed("actual", "label")


@query("weighted_log_loss", f"with {PROBABILITIES} select task, round(sum(-ln(p) * w) / sum(w), 6) as loss from weighted group by task")
def weighted_log_loss(read, spark):
    pred = probabilities(read)
    return rounded(S.weighted_log_loss(pred, _weights(pred)))


@query("focal_loss", f"with {PROBABILITIES} select task, round(avg(w * pow(1 - p, 2) * -ln(p)), 6) as loss from weighted group by task")
def focal_loss(read, spark):
    pred = probabilities(read)
    return rounded(S.focal_loss(pred, _weights(pred)))


@query("total_loss", f"with {PROBABILITIES} select round(sum(l), 6) as loss from (select sum(-ln(p)) / count(*) as l from weighted group by task)")
def total_loss(read, spark):
    return rounded(S.total_loss(S.weighted_log_loss(probabilities(read))))


@query(
    "softmax",
    """with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
    m as (select *, exp(x - max(x) over (partition by vec_id)) as y from e)
    select vec_id, cast(i as integer) as i, round(y / sum(y) over (partition by vec_id), 6) as p from m""",
)
def softmax(read, spark):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    probs = read("embeddings").select("vec_id", F.posexplode(C.softmax(logits)).alias("i", "p"))
    return probs.select("vec_id", (F.col("i") + 1).alias("i"), F.round("p", 6).alias("p"))


@query(
    "argmax",
    """with e as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
    r as (select *, row_number() over (partition by vec_id order by x desc, i) as r from e)
    select vec_id, cast(i - 1 as integer) as predicted from r where r = 1""",
)
def argmax(read, spark):
    return read("embeddings").select("vec_id", C.argmax(F.col("embedding")).alias("predicted"))


@query(
    "evaluate",
    f"with {PREDICTIONS}, known as (select * from predictions where task <> 'any'), {scored('known')} select * from scores",
)
def evaluate(read, spark):
    """Rows of a task the model does not know carry no task and are left out."""
    pred = predictions(read).withColumn("task", F.when(F.col("task") != "any", F.col("task")))
    return rounded(S.evaluate(pred))


@query(
    "keyword_rule_scores",
    f"""with {RANKED},
    docs as (select doc_id, {T.clean_text('text')} as text from documents),
    test as (select s.task, s.value as actual, cast(contains(d.text, '***') as integer) as predicted
             from splits s join docs d using (doc_id) where s.split = 'test'),
    {scored('test')} select * from scores""",
)
def keyword_rule_scores(read, spark):
    """How good is a keyword rule on the test split: clean, reshape, split, predict, score."""
    test = SP.stratified_split(I.long(read), "doc_id").where(F.col("split") == "test")
    test = written(test.select("doc_id", "task", F.col("value").alias("actual")), "test-rows")
    # only texts of the test rows are cleaned, and only their flag travels
    asked = read("documents").join(test.select("doc_id").distinct(), "doc_id", "left_semi")
    rule = F.contains(clean_text(F.col("text")), F.lit("***")).cast("int")
    pred = test.join(asked.select("doc_id", rule.alias("predicted")), "doc_id").select("task", "actual", "predicted")
    return rounded(S.scores_by_task(pred))


RUNS = """
runs as (
  select l_linestatus as dataset, l_returnflag as model, 'part' || cast(l_partkey as varchar) as target, round(avg(l_discount), 6) as accuracy
  from lineitem group by all)"""


def runs(read):
    """Mean discount as the score of a model (return flag) on a data variant (status) and target (part)."""
    return read("lineitem").groupBy(
        F.col("l_linestatus").alias("dataset"),
        F.col("l_returnflag").alias("model"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("target"),
    ).agg(F.round(F.avg("l_discount"), 6).alias("accuracy"))


@query(
    "best_runs",
    f"with {RUNS}, r as (select *, row_number() over (partition by dataset, target order by accuracy desc, model) as r from runs) select dataset, model, target, accuracy from r where r = 1",
)
def best_runs(read, spark):
    return R.best_runs(runs(read))


@query(
    "compare_runs",
    f"""with {RUNS} select model, target, coalesce(max(case when dataset = 'O' then accuracy end), -1) as base,
    coalesce(max(case when dataset = 'F' then accuracy end), -1) as other,
    coalesce(round(max(case when dataset = 'F' then accuracy end) - max(case when dataset = 'O' then accuracy end), 6), -9) as gain
    from runs group by model, target""",
)
def compare_runs(read, spark):
    both = R.compare_runs(runs(read), "O", "F")
    return both.withColumn("gain", F.round("gain", 6)).na.fill({"base": -1.0, "other": -1.0, "gain": -9.0})
