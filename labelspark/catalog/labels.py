"""Derivations, joins and aggregations on label tables."""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog.registry import query
from labelspark.functions import columns as C
from labelspark.operators import labels as L
from labelspark.operators.grid import Grid

SOURCE_MAP = {"src0": "news", "src1": "news", "src2": "forum", "src3": "forum", "src4": "forum", "src5": "wiki"}
SOURCE_CASE = "case " + " ".join(f"when source = '{k}' then '{v}'" for k, v in SOURCE_MAP.items()) + " end"


@query("select_by_prefix", "select c_custkey, c_name, c_nationkey from customer")
def select_by_prefix(read, spark):
    return L.select_by_prefix(read("customer"), "c_na", keep=["c_custkey"])


FLAG_GROUPS_SQL = f"""
with {I.ANNOTATIONS}
select comment_id, l_linenumber,
       cast(target_flag_a or target_flag_r as integer) as flag, cast(target_size as integer) as size,
       cast(target_status_o as integer) as status
       {{extra}}
from annotations
"""


@query("collapse_flag_groups", FLAG_GROUPS_SQL.format(extra=""))
def collapse_flag_groups(read, spark):
    return L.collapse_flag_groups(I.annotations(read), I.ANNOTATION_FLAGS, keep=["comment_id", "l_linenumber"])


@query(
    "any_flag",
    FLAG_GROUPS_SQL.format(
        extra=", cast(target_flag_a or target_flag_r or target_size or target_status_o as integer) as contains_hate"
    ),
)
def any_flag(read, spark):
    keep = ["comment_id", "l_linenumber"]
    return L.collapse_flag_groups(I.annotations(read), I.ANNOTATION_FLAGS, keep, general="contains_hate")


@query("label_from_value", "select doc_id, cast(lang = 'fr' as integer) as value from documents")
def label_from_value(read, spark):
    return read("documents").select("doc_id", C.label_from_value(F.col("lang"), "fr").alias("value"))


@query("map_values", f"select doc_id, {SOURCE_CASE} as task from documents")
def map_values(read, spark):
    return read("documents").select("doc_id", C.map_values(F.col("source"), SOURCE_MAP).alias("task"))


@query(
    "drop_null_task",
    f"select doc_id, task from (select doc_id, {SOURCE_CASE} as task from documents) where task is not null",
)
def drop_null_task(read, spark):
    mapped = read("documents").select("doc_id", C.map_values(F.col("source"), SOURCE_MAP).alias("task"))
    return mapped.where(F.col("task").isNotNull())


@query("filter_in", "select doc_id, 'romance' as task, 1 as value from documents where lang in ('fr', 'es')")
def filter_in(read, spark):
    rows = read("documents").where(F.col("lang").isin("fr", "es"))
    return rows.select("doc_id", F.lit("romance").alias("task"), F.lit(1).alias("value"))


@query(
    "filter_any_label",
    f"""with {I.ANNOTATIONS}
    select comment_id, l_linenumber, hatespeech from annotations
    where hatespeech = 1 and (target_flag_a or target_size)""",
)
def filter_any_label(read, spark):
    flags = [F.col(c).cast("int").alias(c) for c in I.ANNOTATION_FLAGS]
    rows = I.annotations(read).select("comment_id", "l_linenumber", "hatespeech", *flags)
    wanted = (F.col("hatespeech") == 1) & C.has_any_label(["target_flag_a", "target_size"])
    return rows.where(wanted).select("comment_id", "l_linenumber", "hatespeech")


@query(
    "labels_array",
    "select doc_id, concat_ws('|', case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end) as labels, "
    "cast((quality = 1) as integer) + cast((toxic = 1) as integer) as n from labels",
)
def labels_array(read, spark):
    named = read("labels").select("doc_id", C.labels_array(["toxic", "quality"]).alias("l"))
    return named.select("doc_id", F.array_join("l", "|").alias("labels"), F.size("l").alias("n"))


@query("labels_string", "select doc_id, concat_ws(',', case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end) as labels from labels")
def labels_string(read, spark):
    return read("labels").select("doc_id", C.labels_string(["quality", "toxic"]).alias("labels"))


@query("keep_labelled", "select doc_id from labels where quality = 1 or toxic = 1")
def keep_labelled(read, spark):
    return read("labels").where(F.size(C.labels_array(["quality", "toxic"])) > 0).select("doc_id")


@query(
    "normalise_target",
    "select page_id, coalesce(replace(trim(' ' || nullif(split_part(url, '/', 4), '') || ' x '), ' ', '-'), 'Other') as target from pages",
)
def normalise_target(read, spark):
    section = F.nullif(F.split_part("url", F.lit("/"), F.lit(4)), F.lit(""))
    raw = F.concat(F.lit(" "), section, F.lit(" x "))
    return read("pages").select("page_id", C.normalise_target(raw).alias("target"))


GROUPS = [("src0", "first"), ("src1", "first"), ("src2", "second")]


@query(
    "group_target",
    "select doc_id, case when source in ('src0', 'src1') then 'first' when source = 'src2' then 'second' else source end as target from documents",
)
def group_target(read, spark):
    groups = spark.createDataFrame(GROUPS, "task string, base_task string")
    rows = read("documents").select("doc_id", F.col("source").alias("task"))
    return L.rename_groups(rows, groups).select("doc_id", F.col("task").alias("target"))


@query(
    "severity_label",
    "select l_orderkey, l_linenumber, l_linestatus || ' ' || case when l_returnflag = 'A' then 'Level 0' else l_returnflag end as value from lineitem",
)
def severity_label(read, spark):
    level = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    return read("lineitem").select(
        "l_orderkey", "l_linenumber", C.severity_label(F.col("l_linestatus"), level).alias("value")
    )


@query("rename_drop_assign", "select text, lang as task_name, 1 as value from documents")
def rename_drop_assign(read, spark):
    docs = read("documents").drop("doc_id", "source", "n_chars")
    return docs.withColumnRenamed("lang", "task_name").withColumn("value", F.lit(1))


@query("binary_dataset", f"with {I.CORPUS} select content as text, cast(found as integer) as target from corpus")
def binary_dataset(read, spark):
    found = C.label_from_value(F.col("found_manipulation"), "yes")
    return I.corpus(read).select(F.col("content").alias("text"), found.alias("target"))


@query("cast_label_type", "select doc_id, cast(n_chars as integer) as value from documents")
def cast_label_type(read, spark):
    rows = read("documents").select("doc_id", F.col("n_chars").cast("string").alias("value"))
    return L.cast_label_type(rows, "int")


@query(
    "majority_vote",
    f"""with {I.ANNOTATIONS},
    votes as (
      select comment_id, 'hatespeech' as k, cast(hatespeech as varchar) as v from annotations union all
      select comment_id, 'level', level from annotations union all
      select comment_id, 'target_flag_a', cast(cast(target_flag_a as integer) as varchar) from annotations union all
      select comment_id, 'target_size', cast(cast(target_size as integer) as varchar) from annotations
    ),
    counted as (select comment_id, k, v, count(*) as n from votes group by all),
    best as (select *, row_number() over (partition by comment_id, k order by n desc, v) as r from counted)
    select comment_id, cast(max(case when k = 'hatespeech' then v end) as integer) as hatespeech,
           max(case when k = 'level' then v end) as level,
           cast(max(case when k = 'target_flag_a' then v end) as integer) as target_flag_a,
           cast(max(case when k = 'target_size' then v end) as integer) as target_size
    from best where r = 1 group by comment_id""",
)
def majority_vote(read, spark):
    flags = ["target_flag_a", "target_size"]
    return L.majority_vote(I.annotations(read), "comment_id", ["hatespeech", "level", *flags], flags)


@query(
    "attach_text",
    f"""with {I.ANNOTATIONS},
    best as (select comment_id, hatespeech, row_number() over (partition by comment_id order by count(*) desc, hatespeech) as r
             from annotations group by comment_id, hatespeech)
    select t.comment_id, t.text, b.hatespeech from (select distinct comment_id, text from annotations) t
    join best b on b.comment_id = t.comment_id and b.r = 1""",
)
def attach_text(read, spark):
    rows = I.annotations(read)
    return L.attach_text(L.majority_vote(rows, "comment_id", ["hatespeech"]), rows, "comment_id")


@query(
    "complete_grid",
    "select md5(t.text) as text_md5, s.source as target, 0 as value from (select distinct text from documents) t "
    "cross join (select distinct source from documents) s",
)
def complete_grid(read, spark):
    grid = L.complete_grid(I.comments(read))
    return grid.select(F.md5("text").alias("text_md5"), "target", "value")


GRID_TARGETS = [f"src{i}" for i in range(20)]


@query(
    "grid_wide",
    f"""with {I.COMMENTS},
    known as (select text, target, max_by(value, doc_id) as value from comments where value <> 0 group by text, target)
    select md5(t.text) as text_md5, {", ".join(f"coalesce(max(case when k.target = '{t}' then k.value end), 0) as {t}" for t in GRID_TARGETS)}
    from (select distinct text from comments) t left join known k on k.text = t.text group by t.text""",
)
def grid_wide(read, spark):
    """The completed grid as one row per text and one column per target, without a row per cell."""
    return Grid.of_rows(I.comments(read), "doc_id", id_col="text_md5").wide(GRID_TARGETS).drop("text")


@query(
    "grid_counts",
    f"""with {I.COMMENTS},
    known as (select text, target, max_by(value, doc_id) as value from comments where value <> 0 group by text, target),
    cells as (select t.text, s.target, coalesce(k.value, 0) as value from (select distinct text from comments) t
              cross join (select distinct target from comments) s left join known k on k.text = t.text and k.target = s.target)
    select target, value, count(*) as n from cells group by target, value""",
)
def grid_counts(read, spark):
    """Rows per target and value of the completed grid, from its factors."""
    return Grid.of_rows(I.comments(read), "doc_id").counts()


@query(
    "types_wide",
    f"""with {I.CORPUS}
    select comment_id, {", ".join(f"cast(list_contains(types, '{t}') as integer) as {t}" for t in ("user", "assistant", "system"))} from corpus""",
)
def types_wide(read, spark):
    """One column per annotation type, from the rows' type lists."""
    return Grid.of_types(L.with_types(I.corpus(read)), "comment_id").wide(["user", "assistant", "system"])


@query(
    "overlay_values",
    f"""with {I.COMMENTS},
    grid as (select t.text, s.target from (select distinct text from comments) t
             cross join (select distinct target from comments) s),
    known as (select text, target, max_by(value, doc_id) as value from comments where value <> 0 group by text, target)
    select md5(g.text) as text_md5, g.target, coalesce(k.value, 0) as value
    from grid g left join known k on k.text = g.text and k.target = g.target""",
)
def overlay_values(read, spark):
    rows = I.comments(read)
    merged = L.overlay_values(L.complete_grid(rows), rows, "doc_id")
    return merged.select(F.md5("text").alias("text_md5"), "target", "value")


@query(
    "expand_types",
    f"""with {I.CORPUS}
    select c.comment_id, c.content as text, t.target, cast(list_contains(c.types, t.target) as integer) as value
    from corpus c cross join (select distinct unnest(types) as target from corpus) t""",
)
def expand_types(read, spark):
    rows = L.with_types(I.corpus(read)).withColumnRenamed("content", "text")
    return L.expand_types(rows, ["comment_id", "text"])


@query(
    "distinct_types",
    f"with {I.CORPUS} select target, count(*) as n from (select unnest(types) as target from corpus) group by target",
)
def distinct_types(read, spark):
    typed = L.with_types(I.corpus(read))
    counts = typed.select(F.explode("types").alias("target")).groupBy("target").count().withColumnRenamed("count", "n")
    return L.distinct_types(typed).join(counts, "target")


@query(
    "keep_frequent_targets",
    "select page_id, target from (select page_id, split_part(url, '/', 3) as target, count(*) over (partition by split_part(url, '/', 3)) as n from pages) where n > 5",
)
def keep_frequent_targets(read, spark):
    rows = read("pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("target"))
    return L.keep_frequent_targets(rows)


@query("target_counts", "select source as target, count(*) as n from documents group by source")
def target_counts(read, spark):
    return L.target_counts(I.comments(read))


@query(
    "class_counts",
    f"""with {I.LONG}, c as (select task, value, count(*) as n from long group by all)
    select task, value, n, first_value(value) over (partition by task order by n, value) as minority from c""",
)
def class_counts(read, spark):
    return L.class_counts(I.long(read))


@query(
    "class_weights",
    f"""with {I.LONG}
    select task, value,
           round(sum(count(*)) over (partition by task) / (count(*) over (partition by task) * count(*)), 6) as weight
    from long group by task, value""",
)
def class_weights(read, spark):
    return L.class_weights(I.long(read)).withColumn("weight", F.round("weight", 6))


DOC_TASKS = """
tasks as (
  select doc_id, 'lang' as task, lang as value from documents
  union all select doc_id, 'source', source from documents
)"""


def doc_tasks(read):
    return read("documents").select("doc_id", "lang", "source").unpivot("doc_id", ["lang", "source"], "task", "value")


@query(
    "class_map",
    f"with {DOC_TASKS} select task, value, cast(dense_rank() over (partition by task order by value) - 1 as integer) as idx from (select distinct task, value from tasks)",
)
def class_map(read, spark):
    return L.class_map(doc_tasks(read))


ENCODE_SQL = f"""
with {DOC_TASKS},
known as (select task, value, dense_rank() over (partition by task order by value) - 1 as idx
          from (select distinct task, value from tasks where task = 'lang')),
positions as (select task, row_number() over (order by task) - 1 as task_idx from (select distinct task from known))
select t.doc_id, t.task, t.value, cast(p.task_idx as integer) as task_idx, cast(k.idx as integer) as label_idx
from tasks t left join positions p on p.task = t.task left join known k on k.task = t.task and k.value = t.value
"""


@query("encode_labels", f"select doc_id, task, value, coalesce(task_idx, -1) as task_idx, coalesce(label_idx, -1) as label_idx from ({ENCODE_SQL})")
def encode_labels(read, spark):
    rows = doc_tasks(read)
    known = L.class_map(rows.where(F.col("task") == "lang"))
    return L.encode_labels(rows, known, "ignore").na.fill(-1, ["task_idx", "label_idx"])


@query(
    "encode_wide",
    """with docs as (select doc_id, dense_rank() over (order by lang) - 1 as a, dense_rank() over (order by source) - 1 as b from documents)
    select doc_id, cast(a as varchar) || ',' || cast(b as varchar) as labels from docs""",
)
def encode_wide(read, spark):
    coded = L.encode_wide(read("documents"), L.class_map(doc_tasks(read)), ["lang", "source"])
    return coded.select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("unknown_tasks", f"with {DOC_TASKS} select task, count(*) as n from tasks where task <> 'lang' group by task")
def unknown_tasks(read, spark):
    rows = doc_tasks(read)
    return L.unknown_tasks(rows, L.class_map(rows.where(F.col("task") == "lang")))


@query(
    "decode_labels",
    f"""with {DOC_TASKS},
    known as (select task, value, dense_rank() over (partition by task order by value) - 1 as idx
              from (select distinct task, value from tasks))
    select t.doc_id, t.task, cast(k.idx as integer) as predicted, t.value as predicted_label
    from tasks t join known k on k.task = t.task and k.value = t.value""",
)
def decode_labels(read, spark):
    rows = doc_tasks(read)
    classes = L.class_map(rows)
    coded = L.encode_labels(rows, classes).select("doc_id", "task", F.col("label_idx").alias("predicted"))
    return L.decode_labels(coded, classes)


ORDER_GROUPS = [("BUILDING", "house"), ("FURNITURE", "house"), ("MACHINERY", "plant")]


@query(
    "rename_groups",
    "select c_custkey, case when c_mktsegment in ('BUILDING', 'FURNITURE') then 'house' when c_mktsegment = 'MACHINERY' then 'plant' else c_mktsegment end as task from customer",
)
def rename_groups(read, spark):
    groups = spark.createDataFrame(ORDER_GROUPS, "task string, base_task string")
    return L.rename_groups(read("customer").select("c_custkey", F.col("c_mktsegment").alias("task")), groups)


@query(
    "only_known_tasks",
    "select l_orderkey, l_linenumber, n_name as task from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey "
    "where n_name in (select distinct n_name from nation join customer on c_nationkey = n_nationkey where c_acctbal > 9990)",
)
def only_known_tasks(read, spark):
    return _known_and_skipped(read)[0].select("l_orderkey", "l_linenumber", "task")


@query(
    "skipped_tasks",
    "select n_name as task, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey "
    "where n_name not in (select distinct n_name from nation join customer on c_nationkey = n_nationkey where c_acctbal > 9990) group by n_name",
)
def skipped_tasks(read, spark):
    return _known_and_skipped(read)[1]


def _known_and_skipped(read):
    nation = read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("task"))
    rows = read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, "s_nationkey")
    rich = read("customer").where(F.col("c_acctbal") > 9990).select(F.col("c_nationkey").alias("s_nationkey"))
    return L.only_known_tasks(rows, rich.join(nation, "s_nationkey"))


@query(
    "label_totals",
    "select 'quality' as target, cast(sum(quality) as bigint) as total from labels union all select 'toxic', cast(sum(toxic) as bigint) from labels",
)
def label_totals(read, spark):
    return L.label_totals(read("labels"), ["quality", "toxic"])
