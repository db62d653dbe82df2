"""Generated rows: out of the generator's answers, into the train split, and the batches sent to it."""

from pyspark.sql import functions as F

from labelspark.functions.generated import extract_fenced_json, parse_records, text_list, was_rejected
from labelspark.operators.labels import cast_label_type, only_known_tasks
from labelspark.operators.ranks import chunk_of, row_index

# Fixed value: the form of one row in a batch.
BATCH_LINE = "Comment: {text}\nIndex: {index}\nLabels: {labels}"


def read_answers(df, raw="answer", keep=()):
    """(one row per generated record, rows whose answer could not be read)"""
    records = parse_records(extract_fenced_json(F.col(raw)))
    rows = df.select(*keep, F.explode(records).alias("_r")).select(
        *keep,
        F.try_element_at("_r", F.lit("index")).cast("bigint").alias("index"),
        F.coalesce(
            F.try_element_at("_r", F.lit("original_comment")), F.try_element_at("_r", F.lit("comment"))
        ).alias("original_comment"),
        F.coalesce(
            text_list(F.try_element_at("_r", F.lit("labels"))), text_list(F.try_element_at("_r", F.lit("label")))
        ).alias("labels"),
        text_list(F.try_element_at("_r", F.lit("generated_comments"))).alias("generated_comments"),
    )
    return rows, df.where(was_rejected(F.col(raw))).select(*keep, raw)


def augment_train(base, extra, label="value"):
    """(base with the extra rows in its train split, tasks of extra the base does not have)

    Extra rows are positives; validation and test stay as they are.
    """
    kept, skipped = only_known_tasks(extra, base)
    rows = cast_label_type(kept.withColumn(label, F.lit(1)), base.schema[label].dataType.simpleString(), label)
    rows = rows.withColumn("split", F.lit("train"))
    return base.unionByName(rows, allowMissingColumns=True), skipped


def prompt_batches(df, id_col, size, text="text", labels="labels", template=BATCH_LINE):
    """Rows in id order packed `size` at a time into one block of text, with a running index.

    `id_col` is an integer column, or a list of columns of which the first is one; rows of equal ids are in any order. A
    batch number depends on the row order alone, so a failed range can be built again by filter.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    indexed = row_index(df.select(*ids, text, labels), ids)
    # a missing text or label leaves its place empty: every row has a line
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, labels)}
    parts = {"{text}": F.trim(cells[text]), "{index}": F.col("row_index").cast("string"), "{labels}": cells[labels]}
    line = F.lit(template)
    for slot, value in reversed(parts.items()):
        line = F.replace(line, F.lit(slot), value)
    lines = indexed.select(chunk_of("row_index", size).alias("batch"), F.struct("row_index", line.alias("line")).alias("_l"))
    blocks = lines.groupBy("batch").agg(F.array_sort(F.collect_list("_l")).alias("_l"))
    return blocks.select(
        "batch",
        F.size("_l").alias("n"),
        F.col("_l")[0]["row_index"].alias("first_index"),
        F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("block"),
    )
