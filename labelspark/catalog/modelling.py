"""Tokens, vectors, languages and count heads over whole tables."""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog.registry import query
from labelspark.catalog.scoring import rounded, scored
from labelspark.catalog.splitting import RANKED
from labelspark.functions import columns as C
from labelspark.operators import centroids as CE
from labelspark.operators import language as LG
from labelspark.operators import linear as LN
from labelspark.operators import split as SP
from labelspark.operators import tokens as T
from labelspark.operators.scores import evaluate
from labelspark.plans import evaluate as EV

TOKENS = """
word_lists as (select doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') as l from documents),
places as (select doc_id, unnest(l) as token, generate_subscripts(l, 1) as g from word_lists),
tokens as (select doc_id, token, row_number() over (partition by doc_id order by g) - 1 as pos from places where token <> '')"""

VOCABULARY = f"""
{TOKENS},
counts as (select token, count(*) as n from tokens group by token),
vocabulary as (select token, cast(row_number() over (order by n desc, token) + 1 as integer) as token_id, n from counts)"""


@query("vocabulary", f"with {VOCABULARY} select token, token_id, n from vocabulary")
def vocabulary(read, spark):
    return T.vocabulary(I.texts(read))


@query(
    "encode_tokens",
    f"""with {VOCABULARY},
    kept as (select t.doc_id, t.pos, coalesce(v.token_id, 1) as id from tokens t left join vocabulary v using (token) where t.pos < 64),
    slots as (select doc_id, unnest(range(64)) as pos from documents)
    select doc_id, string_agg(cast(coalesce(id, 0) as varchar), ' ' order by pos) as input_ids,
           cast(count(id) as integer) as n_tokens
    from slots left join kept using (doc_id, pos) group by doc_id""",
)
def encode_tokens(read, spark):
    docs = I.texts(read)
    coded = T.encode_tokens(docs, T.vocabulary(docs), "doc_id", 64)
    total = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return coded.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), total.alias("n_tokens"))


def pieces(read):
    """Words of the texts cut into `##` pieces after every vowel; the score is the place in the word."""
    cut = F.regexp_replace(F.lower("text"), r"([aeiou])(?=[a-z])", "$1 ##")
    rows = read("conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split(cut, r"[^a-z#]+"), lambda t: t != "")))
    score = F.length("col") + F.col("pos") % 7
    return rows.select("conv_id", "turn", "pos", F.col("col").alias("token"), score.cast("double").alias("attribution"))


@query(
    "merge_wordpieces",
    r"""with cut as (select conv_id, turn, regexp_replace(lower(text), '([aeiou])([a-z])', '\1 ##\2', 'g') as t from conversations),
    twice as (select conv_id, turn, regexp_replace(t, '([aeiou])([a-z])', '\1 ##\2', 'g') as t from cut),
    listed as (select conv_id, turn, string_split_regex(t, '[^a-z#]+') as l from twice),
    raw as (select conv_id, turn, unnest(l) as token, generate_subscripts(l, 1) as g from listed),
    pieces as (select *, row_number() over (partition by conv_id, turn order by g) - 1 as pos from raw where token <> ''),
    words as (select *, sum(case when token like '##%' then 0 else 1 end) over (partition by conv_id, turn order by pos) as w from pieces)
    select conv_id, turn, cast(w as bigint) as word_no, string_agg(regexp_replace(token, '^##', ''), '' order by pos) as word,
           cast(max(length(token) + pos % 7) as double) as attribution
    from words group by conv_id, turn, w""",
)
def merge_wordpieces(read, spark):
    return T.merge_wordpieces(pieces(read), ("conv_id", "turn"))


def vectors(read):
    """Vectors of one label as the positions of one text; the mask leaves out those that start below zero."""
    return read("embeddings").select(
        F.col("label").alias("doc"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vector"),
        (F.col("embedding")[0] >= 0).cast("int").alias("mask"),
    )


POOL_SQL = """
select label as doc, cast(i - 1 as integer) as dim, round({value}, 6) as x
from (select *, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) {where}
group by label, i
"""


def _pool(mode, sql):
    @query(f"pool_{mode}", sql)
    def run(read, spark):
        pooled = T.pool(vectors(read), "doc", mode)
        flat = pooled.select("doc", F.posexplode("pooled").alias("dim", "x"))
        return flat.select("doc", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


_pool("cls", POOL_SQL.format(value="min_by(v, vec_id)", where=""))
_pool("mean", POOL_SQL.format(value="avg(v)", where="where embedding[1] >= 0"))
_pool("last", POOL_SQL.format(value="max_by(v, vec_id)", where="where embedding[1] >= 0"))


@query(
    "nearest_centroid",
    """with flat as (select label, vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
    means as (select label, i, avg(v) as m from flat group by label, i),
    norms as (select label, sqrt(sum(m * m)) as nm from means group by label),
    dots as (select f.vec_id, m.label, sum(f.v * m.m) / sqrt(sum(f.v * f.v)) as d from flat f join means m on m.i = f.i group by f.vec_id, m.label),
    ranked as (select d.vec_id, d.label, d.d / n.nm as c, row_number() over (partition by d.vec_id order by d.d / n.nm desc, d.label) as r
               from dots d join norms n on n.label = d.label)
    select vec_id, label as predicted, round(c, 6) as cosine from ranked where r = 1""",
)
def nearest_centroid(read, spark):
    rows = read("embeddings")
    best = CE.nearest_centroid(rows, CE.centroids(rows), "vec_id")
    return best.withColumn("cosine", F.round("cosine", 6))


LANGUAGE = """
letters as (select doc_id, lang, substr(md5(text), 1, 1) >= '4' as taught, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' as t from documents),
chars as (select doc_id, lang, taught, string_split(t, '') as c from letters),
shifted as (select doc_id, lang, taught, unnest(list_transform(range(1, cast(len(c) - 1 as bigint)), lambda i: c[i] || c[i + 1] || c[i + 2])) as term from chars),
own as (select doc_id, lang, taught, term, count(*) as n from shifted group by all),
counts as (select lang as label, term, sum(n) as n from own where taught group by lang, term),
sizes as (select doc_id, sum(n) as total from own group by doc_id),
floors as (select label, -ln(sum(n) + (select count(distinct term) from counts)) as floor from counts group by label),
parts as (select o.doc_id, c.label, sum(o.n * ln(c.n + 1)) as s from own o join counts c using (term) group by o.doc_id, c.label),
grid as (select s.doc_id, f.label, s.total * f.floor + coalesce(p.s, 0) as logit
         from sizes s cross join floors f left join parts p on p.doc_id = s.doc_id and p.label = f.label),
best as (select doc_id, label as language from (select *, row_number() over (partition by doc_id order by logit desc, label) as r from grid) where r = 1),
detected as (select doc_id, language from documents left join best using (doc_id))"""


def _taught():
    """Three quarters of the texts teach; copies of a text stay on one side."""
    return F.substring(F.md5("text"), 1, 1) >= "4"


def _told(docs):
    return LG.detect_language(docs, LG.language_profiles(docs.where(_taught())), "doc_id")


@query("detect_language", f"with {LANGUAGE} select doc_id, language from detected")
def detect_language(read, spark):
    return _told(I.texts(read))


@query("keep_language", f"with {LANGUAGE} select doc_id, lang from documents join detected using (doc_id) where language = 'fr'")
def keep_language(read, spark):
    docs = I.texts(read)
    return LG.keep_language(docs, _told(docs), "doc_id", "fr").select("doc_id", "lang")


@query(
    "language_report",
    f"""with {LANGUAGE}
    select lang as label, count(*) as n, sum(cast(language is not distinct from lang as integer)) as n_right,
           sum(cast(language is null as integer)) as n_undecided
    from documents join detected using (doc_id) where substr(md5(text), 1, 1) < '4' group by lang""",
)
def language_report(read, spark):
    """Held-out texts per language: how many are told right, and how many not at all."""
    docs = I.texts(read)
    held_out = docs.where(~_taught())
    return LG.language_report(LG.detect_language(held_out, LG.language_profiles(docs.where(_taught())), "doc_id"), held_out, "doc_id")


HEADS = f"""
{RANKED}, {TOKENS},
terms as (select doc_id, token as term, count(*) as n from tokens group by all),
train as (select doc_id, task, value as label from splits where split = 'train'),
counts as (select t.task, t.label, x.term, sum(x.n) as n from terms x join train t using (doc_id) group by all),
priors as (select task, label, ln(count(*) / sum(count(*)) over (partition by task)) as bias from train group by task, label),
known as (select task, count(distinct term) as v from counts group by task),
offsets as (select p.task, p.label, p.bias, -ln(coalesce(s.t, 0) + k.v) as floor
            from priors p join known k using (task) left join (select task, label, sum(n) as t from counts group by all) s using (task, label)),
weights as (select task, label, term, ln(n + 1) as weight from counts)"""

LOGITS = """
logit_sums as (select x.doc_id, w.task, w.label, sum(x.n * w.weight) as s from {terms} x join weights w using (term) group by all),
logits as (select z.doc_id, o.task, o.label, o.bias + coalesce(s.s, 0) + z.total * o.floor as logit
           from (select d.doc_id, coalesce(sum(t.n), 0) as total from {docs} d left join {terms} t using (doc_id) group by d.doc_id) z cross join offsets o
           left join logit_sums s on s.doc_id = z.doc_id and s.task = o.task and s.label = o.label),
exps as (select *, exp(logit - max(logit) over (partition by doc_id, task)) as e from logits),
predicted as (select doc_id, task, cast(max_by(label, logit - label * 1e-9) as integer) as predicted,
                     round(max(case when label = 1 then e else 0 end) / sum(e), 4) as p1 from exps group by doc_id, task)"""


def _heads(read):
    """Heads learned from the train split of the labelled documents."""
    rows = SP.stratified_split(I.long(read), "doc_id")
    train = rows.where(F.col("split") == "train").select("doc_id", "task", F.col("value").alias("label"))
    terms = T.term_lists(I.texts(read), "doc_id")
    return rows, terms, LN.count_heads(terms, train, "doc_id")


@query("predict", f"with {HEADS}, {LOGITS.format(terms='terms', docs='documents')} select doc_id, task, predicted, p1 from predicted")
def predict(read, spark):
    _, terms, heads = _heads(read)
    rows = LN.predict(terms, *heads, "doc_id")
    return rows.select("doc_id", "task", "predicted", F.round(F.col("probs")[1], 4).alias("p1"))


@query(
    "predict_one_task",
    f"with {HEADS}, {LOGITS.format(terms='terms', docs='documents')} select doc_id, task, predicted, p1 from predicted where task = 'toxic'",
)
def predict_one_task(read, spark):
    _, terms, heads = _heads(read)
    rows = LN.predict(terms, *heads, "doc_id", "toxic")
    return rows.select("doc_id", "task", "predicted", F.round(F.col("probs")[1], 4).alias("p1"))


@query(
    "predict_and_score",
    f"""with {HEADS}, {LOGITS.format(terms='terms', docs='documents')},
    tested as (select task, s.value as actual, p.predicted from splits s join predicted p using (doc_id, task) where s.split = 'test'),
    {scored('tested')} select * from scores""",
)
def predict_and_score(read, spark):
    rows, terms, heads = _heads(read)
    test = rows.where(F.col("split") == "test").select("doc_id", "task", F.col("value").alias("actual"))
    asked = terms.join(test.select("doc_id").distinct(), "doc_id", "left_semi")
    pred = LN.predict(asked, *heads, "doc_id").join(test, ["doc_id", "task"])
    return rounded(evaluate(pred))


CORPUS_TASKS = {"user": "toxic", "assistant": "quality"}


@query(
    "cross_corpus_eval",
    f"""with {HEADS},
    other as (select conv_id || '-' || turn as doc_id, case role when 'user' then 'toxic' when 'assistant' then 'quality' end as task,
                     cast(length(text) > 300 as integer) as actual, text from conversations),
    other_parts as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as term from other),
    other_terms as (select doc_id, term, count(*) as n from other_parts where term <> '' group by all),
    {LOGITS.format(terms='other_terms', docs='(select distinct doc_id from other where task is not null)')},
    tested as (select task, o.actual, p.predicted from other o join predicted p using (doc_id, task)),
    {scored('tested')} select * from scores""",
)
def cross_corpus_eval(read, spark):
    """Heads of one corpus on another, whose groups are mapped to the heads' tasks; unmapped groups are ignored."""
    _, _, heads = _heads(read)
    other = read("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        C.map_values(F.col("role"), CORPUS_TASKS).alias("task"),
        (F.length("text") > 300).cast("int").alias("actual"),
        "text",
    )
    return rounded(EV.cross_corpus_eval(other, heads, "doc_id"))


ATTRIBUTIONS = f"""
    {HEADS}, {LOGITS.format(terms='terms', docs='documents')},
    sizes as (select task, count(*) as k, avg(floor) as mean from offsets group by task),
    shown as (select task, term, sum(weight) as total from weights group by all),
    pulls as (select s.term, s.task, o.label, coalesce(w.weight, 0) - s.total / z.k + o.floor - z.mean as pull
              from shown s join offsets o using (task) join sizes z using (task)
              left join weights w on w.task = s.task and w.term = s.term and w.label = o.label),
    token_parts as (select x.doc_id, p.task, p.predicted, x.term, x.n * u.pull as a
              from terms x join predicted p using (doc_id) join pulls u on u.term = x.term and u.task = p.task and u.label = p.predicted),
    normed as (select *, a / sqrt(sum(a * a) over (partition by doc_id, task)) as attribution from token_parts)"""


def attributions(read, operator):
    _, terms, heads = _heads(read)
    pred = LN.predict(terms, *heads, "doc_id")
    return operator(terms, pred, *heads, "doc_id")


@query("attribute_tokens", f"with {ATTRIBUTIONS} select doc_id, task, predicted, term, round(attribution, 5) as attribution from normed")
def attribute_tokens(read, spark):
    """What every term of every text adds to the winning class."""
    return attributions(read, LN.attribute_tokens).withColumn("attribution", F.round("attribution", 5))


@query(
    "top_attributions",
    f"""with {ATTRIBUTIONS},
    term_ranks as (select *, row_number() over (partition by doc_id, task order by round(attribution, 9) desc, term) as rank from normed)
    select doc_id, task, predicted, term, round(attribution, 5) as attribution, cast(rank as integer) as rank from term_ranks where rank <= 5""",
)
def top_attributions(read, spark):
    """The five terms of each text that speak most for the winning class."""
    top = LN.top_terms(attributions(read, LN.term_parts), "doc_id", 5)
    return top.withColumn("attribution", F.round("attribution", 5))


@query(
    "cross_corpus_two_tasks",
    f"""with {HEADS},
    other as (select conv_id || '-' || turn as doc_id, unnest(['toxic', 'quality']) as task, cast(length(text) > 300 as integer) as actual, text from conversations),
    other_texts as (select distinct doc_id, text from other),
    other_parts as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as term from other_texts),
    other_terms as (select doc_id, term, count(*) as n from other_parts where term <> '' group by all),
    {LOGITS.format(terms='other_terms', docs='other_texts')},
    tested as (select task, o.actual, p.predicted from other o join predicted p using (doc_id, task)),
    {scored('tested')} select * from scores""",
)
def cross_corpus_two_tasks(read, spark):
    """A long corpus, every text with a row for two tasks: the text counts once."""
    _, _, heads = _heads(read)
    tasks = F.explode(F.array(F.lit("toxic"), F.lit("quality")))
    other = read("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), tasks.alias("task"), (F.length("text") > 300).cast("int").alias("actual"), "text"
    )
    return rounded(EV.cross_corpus_eval(other, heads, "doc_id"))
