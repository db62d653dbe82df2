"""Round trips: a driver table is written in the form an operator reads, and read back through it.

Files go below the folder the session names in spark.checkpoint.dir, into a new path on every run.
"""

from pyspark.sql import functions as F

from labelspark.catalog import inputs as I
from labelspark.catalog import splitting
from labelspark.catalog.registry import query
from labelspark.functions import generated as G
from labelspark.operators import labels as L
from labelspark.operators import ranks
from labelspark.operators import split as SP
from labelspark.session import shared_folder
from labelspark.sources import readers as R
from labelspark.sources import writers as W


def _write_comments(df, path, sep=";"):
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    return path


def _comments(read):
    return read("documents").select(F.col("text").alias("Comment"), F.col("source").alias("Target"))


@query("read_annotated_csv", "select text as \"Comment\", source as \"Target\", 1 as \"Value\" from documents")
def read_annotated_csv(read, spark):
    path = _write_comments(_comments(read), shared_folder(spark, "annotated"))
    return R.read_annotated_csv(spark, path, label=1)


@query(
    "read_file_list",
    """select md5(text) as text_md5, source as target, cast(lang = 'en' as integer) as value,
    case when lang = 'en' then 'first group' else 'second' end as "group" from documents""",
)
def read_file_list(read, spark):
    folder, files = _two_files(read, spark)
    return R.read_file_list(spark, folder, files).select(F.md5("text").alias("text_md5"), "target", "value", "group")


def _two_files(read, spark):
    folder = shared_folder(spark, "file-list")
    docs = read("documents")
    english, other = docs.where(F.col("lang") == "en"), docs.where(F.col("lang") != "en")
    leveled = english.select(F.col("text").alias("Comment"), F.col("source").alias("Target"))
    _write_comments(leveled, f"{folder}/No. 1 a+b_HS.csv")
    _write_comments(other.select(F.col("text").alias("Comment"), F.col("source").alias("Target")), f"{folder}/No. 1 a+b_N.csv")
    return folder, [("No. 1 a+b_HS.csv", 1, "first group"), ("No. 1 a+b_N.csv", 0, "second")]


@query(
    "read_levels_csv",
    "select md5(text) as text_md5, source as target, case when lang = 'en' then 'Level ' || cast(n_chars % 4 + 1 as varchar) else '-' end as level from documents",
)
def read_levels_csv(read, spark):
    folder = shared_folder(spark, "levels")
    docs = read("documents").select(
        F.col("text").alias("Comment"),
        F.col("source").alias("Target"),
        F.concat(F.lit("Level "), (F.col("n_chars") % 4 + 1).cast("string")).alias("HS Level"),
        "lang",
    )
    _write_comments(docs.where(F.col("lang") == "en").drop("lang"), f"{folder}/hate.csv")
    _write_comments(docs.where(F.col("lang") != "en").select("Comment", "Target"), f"{folder}/none.csv")
    rows = R.read_levels_csv(spark, folder, [("hate.csv", 1, "g"), ("none.csv", 0, "g")])
    return rows.select(F.md5("text").alias("text_md5"), "target", F.coalesce("level", F.lit("-")).alias("level"))


@query("read_plain_csv", "select doc_id, md5(text) as text_md5, lang from documents")
def read_plain_csv(read, spark):
    path = _write_comments(read("documents").select("doc_id", "text", "lang"), shared_folder(spark, "plain"), ",")
    rows = R.read_plain_csv(spark, path, "doc_id bigint, text string, lang string")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang")


def _write_json_arrays(df, number, path, size=1000):
    """One indented JSON array per `size` consecutive numbers, each in a file of its own."""
    batch = ranks.chunk_of(number, size).alias("batch")
    records = df.select(batch, F.to_json(F.struct(*df.columns)).alias("record"))
    arrays = records.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("record")), ",\n  ").alias("value"))
    files = arrays.select("batch", F.concat(F.lit("[\n  "), "value", F.lit("\n]")).alias("value"))
    files.write.partitionBy("batch").text(path)
    return path


@query(
    "read_annotation_json",
    f"with {I.CORPUS} select cast(comment_id as varchar) as comment_id, md5(content) as text_md5, case when found then 'yes' else 'no' end as found_manipulation, cast(2 * len(types) as integer) as n from corpus",
)
def read_annotation_json(read, spark):
    path = _write_json_arrays(I.corpus(read), "comment_id", shared_folder(spark, "annotations"))
    rows = R.read_annotation_json(spark, path)
    return rows.select("comment_id", F.md5("content").alias("text_md5"), "found_manipulation", F.size("annotations").alias("n"))


@query("read_table", "select doc_id, quality, toxic from labels")
def read_table(read, spark):
    path = shared_folder(spark, "table")
    read("labels").write.parquet(path)
    return R.read_table(spark, path)


@query("read_generated_json", "select item_id, md5(text) as text_md5, 1 as n from benchmark")
def read_generated_json(read, spark):
    records = read("benchmark").select(
        F.col("item_id").alias("Index"),
        F.col("text").alias("original_comment"),
        F.array(F.upper("text")).alias("Generated_Comments"),
    )
    path = _write_json_arrays(records, "Index", shared_folder(spark, "generated"), 25)
    fields = R.read_generated_json(spark, path).select(G.coalesce_variants(F.col("record")).alias("r"))
    return fields.select(
        F.col("r")["index"].cast("bigint").alias("item_id"),
        F.md5(F.col("r")["original_comment"]).alias("text_md5"),
        F.size(G.text_list(F.col("r")["generated_comments"])).alias("n"),
    )


@query("write_task_partitions", "select doc_id, 'S,' || source || '/x=' || lang as task from documents")
def write_task_partitions(read, spark):
    task = F.concat(F.lit("S,"), F.col("source"), F.lit("/x="), F.col("lang"))
    rows = read("documents").select("doc_id", task.alias("task"))
    path = W.write_task_partitions(rows, shared_folder(spark, "tasks"))
    return R.load_complete(spark, path)


@query("write_wide", "select md5(text) as text_md5, quality, toxic from documents join labels using (doc_id)")
def write_wide(read, spark):
    path = W.write_wide(I.wide(read).select("text", "quality", "toxic"), shared_folder(spark, "wide"))
    rows = R.read_plain_csv(spark, f"{path}.csv", "text string, quality int, toxic int")
    return rows.select(F.md5("text").alias("text_md5"), "quality", "toxic")


def _written_splits(read, spark):
    return W.write_splits(SP.stratified_split(I.long(read), "doc_id"), shared_folder(spark, "splits"))


@query("write_splits", f"with {splitting.RANKED} select * from splits")
def write_splits(read, spark):
    return R.load_complete(spark, _written_splits(read, spark))


@query("load_task_split", f"with {splitting.RANKED} select * from splits where task = 'toxic' and split = 'validation'")
def load_task_split(read, spark):
    return R.load_task_split(spark, _written_splits(read, spark), "toxic", "validation")


@query("load_all_tasks", f"with {splitting.RANKED} select * from splits where split = 'test'")
def load_all_tasks(read, spark):
    return R.load_all_tasks(spark, _written_splits(read, spark), "test")


@query("load_complete", f"with {splitting.RANKED} select task, count(*) as n from splits group by task")
def load_complete(read, spark):
    return R.load_complete(spark, _written_splits(read, spark)).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rebuild_output",
    f"with {splitting.RANKED} select doc_id, task, case when task = 'toxic' then 1 - value else value end as value, split from splits",
)
def rebuild_output(read, spark):
    """One task is replaced in place, the other stays."""
    path = _written_splits(read, spark)
    rows = SP.stratified_split(I.long(read), "doc_id").where(F.col("task") == "toxic")
    W.replace_tasks(rows.withColumn("value", 1 - F.col("value")), path)
    return R.load_complete(spark, path)


@query("save_class_maps", f"with {I.LONG} select distinct task, value, value as idx from long")
def save_class_maps(read, spark):
    return R.load_class_maps(spark, W.save_class_maps(L.class_map(I.long(read)), shared_folder(spark, "class-maps")))


REPORT_SQL = """
select n_name as model, event_type as target, round(avg(value), 3) as accuracy
from events join nation on n_nationkey = user_id % 25 group by all
"""


@query("read_report", REPORT_SQL)
def read_report(read, spark):
    """Written with decimal commas and with the model only on the first line of its block."""
    path = shared_folder(spark, "report")
    names = read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("model"))
    rows = read("events").withColumn("k", F.col("user_id") % 25).join(names, "k")
    scores = rows.groupBy("model", F.col("event_type").alias("target")).agg(F.round(F.avg("value"), 3).alias("accuracy"))
    first = scores.groupBy("model").agg(F.min("target").alias("_first"))
    cells = scores.join(first, "model").select(
        F.col("model").alias("_order"),
        F.when(F.col("target") == F.col("_first"), F.col("model")).alias("model"),
        "target",
        F.replace(F.col("accuracy").cast("string"), F.lit("."), F.lit(",")).alias("accuracy"),
    )
    sorted_cells = cells.repartition(4, "_order").sortWithinPartitions("_order", "target").drop("_order")
    W.write_report(sorted_cells, path, sep=";")
    return R.read_report(spark, path, ["accuracy"], ["model"])


@query("write_report", "select o_orderpriority as task, count(*) as n, round(avg(o_totalprice), 2) as accuracy from orders group by o_orderpriority")
def write_report(read, spark):
    scores = read("orders").groupBy(F.col("o_orderpriority").alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("accuracy")
    )
    path = W.write_report(scores, shared_folder(spark, "scores"))
    return R.read_plain_csv(spark, path, "task string, n bigint, accuracy double")


@query(
    "fill_down",
    "select event_id, last_value(case when event_type in ('signup', 'error') then event_type end ignore nulls) over (order by event_id) as event_type from events",
)
def fill_down(read, spark):
    marked = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")).alias("event_type")
    return ranks.fill_down(read("events").select("event_id", marked), [], "event_id", ["event_type"], chunk=512)
