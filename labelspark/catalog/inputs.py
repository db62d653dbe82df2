"""Tables the queries start from, derived from the driver's tables, with the same derivation in SQL."""

from pyspark.sql import functions as F

from labelspark.operators.reshape import wide_to_long

ANNOTATION_FLAGS = ["target_flag_a", "target_flag_r", "target_status_o", "target_size"]


def annotations(read):
    """Order lines as annotations of their order: several rows per comment, boolean flags, an ordinal."""
    return read("lineitem").select(
        F.col("l_orderkey").alias("comment_id"),
        "l_linenumber",
        F.concat(F.lit("comment "), F.col("l_orderkey").cast("string")).alias("text"),
        (F.col("l_returnflag") == "A").alias("target_flag_a"),
        (F.col("l_returnflag") == "R").alias("target_flag_r"),
        (F.col("l_linestatus") == "O").alias("target_status_o"),
        (F.col("l_quantity") > 45).alias("target_size"),
        (F.floor(F.col("l_quantity") / 20)).cast("int").alias("hatespeech"),
        F.col("l_returnflag").alias("level"),
    )


ANNOTATIONS = """
annotations as (
  select l_orderkey as comment_id, l_linenumber, 'comment ' || cast(l_orderkey as varchar) as text,
         l_returnflag = 'A' as target_flag_a, l_returnflag = 'R' as target_flag_r, l_linestatus = 'O' as target_status_o,
         l_quantity > 45 as target_size, cast(floor(l_quantity / 20) as integer) as hatespeech, l_returnflag as level
  from lineitem
)"""


def texts(read):
    return read("documents")


def wide(read):
    """Labelled documents, one 0/1 column per task."""
    return texts(read).join(read("labels"), "doc_id")


WIDE = "wide as (select * from documents join labels using (doc_id))"


def long(read):
    """Labels of the documents, one row per document and task."""
    return wide_to_long(read("labels"), "doc_id", ["quality", "toxic"])


LONG = """
long as (
  select doc_id, 'quality' as task, quality as value from labels
  union all
  select doc_id, 'toxic', toxic from labels
)"""


def long_text(read):
    return long(read).join(texts(read), "doc_id")


LONG_TEXT = LONG + ", long_text as (select * from long join documents using (doc_id))"


def comments(read):
    """Documents as comments about a target: the source is the target, German texts are the positives."""
    return read("documents").select(
        "doc_id", "text", F.col("source").alias("target"), (F.col("lang") == "de").cast("int").alias("value")
    )


COMMENTS = """
comments as (
  select doc_id, text, source as target, cast(lang = 'de' as integer) as value from documents
)"""


def corpus(read):
    """Conversations as comments with a nested annotation list; the roles (each twice) are the types."""
    roles = F.collect_set("role")
    return read("conversations").groupBy(F.col("conv_id").alias("comment_id")).agg(
        F.min_by("text", "turn").alias("content"),
        F.when(F.max(F.col("role") == "system"), "yes").otherwise("no").alias("found_manipulation"),
        F.transform(F.concat(roles, roles), lambda r: F.struct(r.alias("technique"))).alias("annotations"),
    )


CORPUS = """
corpus as (
  select conv_id as comment_id, min_by(text, turn) as content, max(role = 'system') as found,
         list_sort(list_distinct(list(role))) as types
  from conversations group by conv_id
)"""
