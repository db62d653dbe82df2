"""Reshapes, set operations and generated rows."""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog.registry import query
from labelspark.functions import columns as C
from labelspark.functions import generated as G
from labelspark.operators import generated as GO
from labelspark.operators import labels as L
from labelspark.operators import reshape as R


@query("wide_to_long", f"with {I.LONG} select doc_id, task, value from long")
def wide_to_long(read, spark):
    return R.wide_to_long(read("labels"), "doc_id")


@query(
    "long_to_wide_unique",
    f"""with {I.COMMENTS},
    firsts as (select *, row_number() over (partition by text order by doc_id) as r from comments)
    select md5(text) as text_md5, {", ".join(f"max(case when target = 'src{i}' then value else 0 end) as src{i}" for i in range(20))}
    from firsts where r = 1 group by text""",
)
def long_to_wide_unique(read, spark):
    wide = R.long_to_wide_unique(I.comments(read), "text", "doc_id", task="target")
    return wide.select(F.md5("text").alias("text_md5"), *[c for c in wide.columns if c != "text"])


@query("long_to_wide_keyed", f"with {I.CORPUS} select comment_id, content as text, cast(list_contains(types, 'assistant') as integer) as assistant, cast(list_contains(types, 'system') as integer) as system, cast(list_contains(types, 'user') as integer) as \"user\" from corpus")
def long_to_wide_keyed(read, spark):
    rows = L.expand_types(L.with_types(I.corpus(read)).withColumnRenamed("content", "text"), ["comment_id", "text"])
    return R.long_to_wide_keyed(rows, ["comment_id", "text"], task="target")


@query(
    "long_to_wide_mean",
    "select l_orderkey, "
    + ", ".join(f"round(coalesce(avg(case when l_returnflag = '{f}' then l_quantity end), 0), 6) as {f}" for f in "ANR")
    + " from lineitem group by l_orderkey",
)
def long_to_wide_mean(read, spark):
    rows = read("lineitem").select("l_orderkey", F.col("l_returnflag").alias("task"), F.col("l_quantity").alias("value"))
    wide = R.long_to_wide_mean(rows, "l_orderkey")
    return wide.select("l_orderkey", *[F.round(c, 6).alias(c) for c in "ANR"])


@query(
    "stack_tasks",
    "select doc_id, source as task, 1 as value from documents union all select doc_id, 'contains_hate', cast(lang = 'en' as integer) from documents",
)
def stack_tasks(read, spark):
    tasks = [(F.col("source"), F.lit(1)), (F.lit("contains_hate"), C.label_from_value(F.col("lang"), "en"))]
    return R.stack_tasks(read("documents"), ["doc_id"], tasks)


@query(
    "append_rows",
    f"with {I.COMMENTS} select doc_id, target, value from comments union all select item_id, 'benchmark', 1 from benchmark",
)
def append_rows(read, spark):
    extra = read("benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("target"), F.lit(1).alias("value"))
    return R.append_rows(I.comments(read).select("doc_id", "target", "value"), extra)


@query("drop_duplicate_rows", f"with {I.COMMENTS} select distinct md5(text) as text_md5, target from comments")
def drop_duplicate_rows(read, spark):
    return I.comments(read).select(F.md5("text").alias("text_md5"), "target").distinct()


@query("drop_duplicate_text", f"with {I.COMMENTS} select doc_id, target, value, md5(text) as text_md5 from (select *, row_number() over (partition by text order by doc_id) as r from comments) where r = 1")
def drop_duplicate_text(read, spark):
    hashed = I.comments(read).select("doc_id", "target", "value", F.md5("text").alias("text_md5"))
    return R.drop_duplicate_text(hashed, "text_md5", "doc_id")


@query(
    "concat_groups",
    "select c_custkey as id, c_name as name from customer union all select s_suppkey, s_name from supplier union all select p_partkey, p_name from part",
)
def concat_groups(read, spark):
    names = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    return R.concat_groups(
        [read(t).select(F.col(k).cast("bigint").alias("id"), F.col(n).alias("name")) for t, (k, n) in names.items()]
    )


@query("remaining", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def remaining(read, spark):
    finished = read("orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return R.remaining(read("customer").select("c_custkey"), finished, "c_custkey")


def _generated(read):
    """Three rewrites per benchmark item, with none to two labels."""
    text = F.col("text")
    texts = F.array(F.concat(F.lit("first "), text), F.concat(F.lit("SECOND "), text), F.concat(F.lit("third "), text))
    labels = F.array_compact(F.array(F.when(text.contains("sh"), "a"), F.when(text.contains("tion"), "b")))
    return read("benchmark").select("item_id", "text", texts.alias("generated_comments"), labels.alias("labels"))


GENERATED = """
prefixes as (select * from (values (1, 'first '), (2, 'SECOND '), (3, 'third ')) v(k, prefix)),
labelled as (
  select item_id, 'a' as target from benchmark where contains(text, 'sh')
  union all select item_id, 'b' from benchmark where contains(text, 'tion')
)"""


@query(
    "first_k",
    f"with {GENERATED} select item_id, string_agg(md5(prefix || text), ',' order by k) as texts from benchmark, prefixes where k <= 2 group by item_id",
)
def first_k(read, spark):
    kept = C.first_k(F.col("generated_comments"), 2)
    return _generated(read).select("item_id", F.array_join(F.transform(kept, F.md5), ",").alias("texts"))


@query(
    "drop_elements_containing",
    f"with {GENERATED} select item_id, string_agg(md5(prefix || text), ',' order by k) as texts from benchmark, prefixes where k <> 2 and not contains(lower(text), 'second') group by item_id",
)
def drop_elements_containing(read, spark):
    kept = C.drop_elements_containing(F.col("generated_comments"), "Second")
    return _generated(read).select("item_id", F.array_join(F.transform(kept, F.md5), ",").alias("texts"))


@query(
    "unmask",
    r"select doc_id, regexp_replace(regexp_replace(replace(text, 'the', 'T***E'), 't\*\*\*e', '[the]', 'gi'), 'on', 'off', 'gi') as text from documents",
)
def unmask(read, spark):
    masked = F.replace(F.col("text"), F.lit("the"), F.lit("T***E"))
    return read("documents").select("doc_id", C.unmask(masked, {"t***e": "[the]", "on": "off"}).alias("text"))


@query(
    "explode_generated",
    f"with {GENERATED} select b.item_id, md5(p.prefix || b.text) as text_md5, l.target from benchmark b cross join prefixes p left join labelled l using (item_id) where k = 1",
)
def explode_generated(read, spark):
    picked = _generated(read).select("item_id", C.first_k(F.col("generated_comments"), 1).alias("selected"), "labels")
    return R.explode_generated(picked).select("item_id", F.md5("text").alias("text_md5"), "target")


@query(
    "product_rows",
    f"with {GENERATED} select b.item_id, md5(p.prefix || b.text) as text_md5, l.target, cast(l.target is not null as integer) as value from benchmark b cross join prefixes p left join labelled l using (item_id)",
)
def product_rows(read, spark):
    rows = R.product_rows(_generated(read), keep=["item_id"])
    return rows.select("item_id", F.md5("text").alias("text_md5"), "target", "value")


def _answers(read):
    """Generator answers: prose around a fenced list of records, those about some "ing" cut off in the middle."""
    record = F.to_json(
        F.array(
            F.struct(
                F.col("item_id").alias("Index"),
                F.col("text").alias("Original_Comment"),
                F.col("labels").alias("labels"),
                F.col("generated_comments").alias("Generated_Comments"),
            )
        )
    )
    body = F.when(F.col("text").contains("ing"), F.substring(record, 1, 40)).otherwise(record)
    answer = F.concat(F.lit("Here they are:\n```JSON\n"), body, F.lit("\n```\nDone."))
    return _generated(read).select("item_id", answer.alias("answer"))


@query("extract_fenced_json", "select event_id, props as body from events")
def extract_fenced_json(read, spark):
    fenced = F.concat(F.lit("intro ```Json\n "), F.col("props"), F.lit("  \n``` rest ```json {} ```"))
    return read("events").select("event_id", G.extract_fenced_json(fenced).alias("body"))


@query(
    "parse_records",
    "select item_id, item_id as index, md5(text) as text_md5, 3 as n_texts, cast(contains(text, 'sh') as integer) + cast(contains(text, 'tion') as integer) as n_labels from benchmark where not contains(text, 'ing')",
)
def parse_records(read, spark):
    rows, _ = GO.read_answers(_answers(read), keep=["item_id"])
    return rows.select(
        "item_id",
        "index",
        F.md5("original_comment").alias("text_md5"),
        F.size("generated_comments").alias("n_texts"),
        F.size("labels").alias("n_labels"),
    )


@query("rejected_answers", "select item_id from benchmark where contains(text, 'ing')")
def rejected_answers(read, spark):
    return GO.read_answers(_answers(read), keep=["item_id"])[1].select("item_id")


@query(
    "coalesce_variants",
    "select event_id, cast(json_extract(props, '$.k') as integer) as k, event_type as kind from events",
)
def coalesce_variants(read, spark):
    """The same field under differently written names, some of them null."""
    head = F.when(F.col("event_type").isin("view", "error"), F.lit('{"Kind": null, "KIND": "')).otherwise(F.lit('{"kind": "'))
    record = F.concat(head, F.col("event_type"), F.lit('", "K": '), F.regexp_extract("props", r"(\d+)", 1), F.lit("}"))
    fields = G.coalesce_variants(F.from_json(record, "map<string,string>"))
    return read("events").select("event_id", fields["k"].cast("int").alias("k"), fields["kind"].alias("kind"))


@query(
    "relabel_generated",
    """select d.doc_id as item_id, md5(d.text) as text_md5, s.source as labels from documents d
    join documents s on s.text = d.text and s.lang <> 'en'""",
)
def relabel_generated(read, spark):
    """Sources with a text of several rows give the labels of each."""
    docs = read("documents")
    generated = docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("original_comment"), F.lit("?").alias("labels"))
    joined = L.relabel_generated(generated, docs.where(F.col("lang") != "en").select("text", F.col("source").alias("labels")))
    return joined.select("item_id", F.md5("original_comment").alias("text_md5"), "labels")


BATCH_SQL = """
with indexed as (select *, row_number() over (order by conv_id, turn) - 1 as i from conversations),
lines as (select i // 70 as batch, i, 'Comment: ' || trim(coalesce({text}, '')) || chr(10) || 'Index: ' || cast(i as varchar) || chr(10) || 'Labels: ' || coalesce({labels}, '') as line from indexed)
select batch, cast(count(*) as integer) as n, min(i) as first_index, string_agg(line, chr(10) order by i) as block from lines group by batch
"""


@query("prompt_batches", BATCH_SQL.format(text="text", labels="role"))
def prompt_batches(read, spark):
    return GO.prompt_batches(read("conversations"), ["conv_id", "turn"], 70, labels="role")


@query("prompt_batches_with_gaps", BATCH_SQL.format(text="nullif(text, (select min(text) from conversations where turn = 0))", labels="nullif(role, 'user')"))
def prompt_batches_with_gaps(read, spark):
    """Rows without a text or a label keep their line."""
    rows = read("conversations")
    least = rows.where(F.col("turn") == 0).agg(F.min("text").alias("_least"))
    gaps = rows.join(F.broadcast(least), F.col("text") == F.col("_least"), "left")
    gaps = gaps.withColumn("text", F.when(F.col("_least").isNull(), F.col("text"))).withColumn("role", F.nullif("role", F.lit("user")))
    return GO.prompt_batches(gaps, ["conv_id", "turn"], 70, labels="role")


@query(
    "unmatched_generated",
    """with sources as (select distinct text from documents where lang <> 'en')
    select md5(text) as text_md5, count(*) as n from documents where text is not null and text not in (select text from sources) group by text""",
)
def unmatched_generated(read, spark):
    """Generated rows whose source text has no labels, by source text."""
    docs = read("documents")
    generated = docs.select(F.col("text").alias("original_comment"), "doc_id")
    labelled = docs.where(F.col("lang") != "en").select("text", F.col("source").alias("labels"))
    missing = L.unmatched_generated(generated, labelled)
    return missing.select(F.md5("original_comment").alias("text_md5"), "n")
