"""From annotated tables to split label tables, as one plan each."""

from pyspark.sql import functions as F

from labelspark.functions.columns import first_k, label_from_value, map_values, normalise_target, severity_label
from labelspark.functions.generated import text_list
from labelspark.operators import labels as L
from labelspark.operators.grid import Grid
from labelspark.operators import reshape as R
from labelspark.operators import split as S
from labelspark.session import written
from labelspark.sources.writers import write_splits

# Fixed value: the task made of a comment's gold answer.
GENERAL_TASK = "Contains manipulation"


def comment_targets(df, use_groups=False, min_rows=5):
    """Normalised targets of comment rows (text, target, value[, group]) with enough rows each."""
    target = F.col("group") if use_groups else F.col("target")
    named = df.withColumn("target", normalise_target(target))
    return L.keep_frequent_targets(named, more_than=min_rows).drop("group")


def build_long(df, id_col, extra=None, complete=False, use_groups=False, ratio=None, seed=42, balance_first=False):
    """(split long table, skipped tasks) from comment rows: targets, optional grid, optional balance, split."""
    rows = df.select(id_col, "text", "target", "value", *(["group"] if use_groups else []))
    if extra is not None:
        rows = rows.unionByName(extra, allowMissingColumns=True)
    rows = comment_targets(rows, use_groups)
    options = dict(ratio=ratio, seed=seed, balance_first=balance_first)
    if not complete:
        return S.split_every_task(rows.withColumnRenamed("target", "task"), id_col, **options)
    # only ids are unfolded, split and drawn; texts come at the end
    grid = Grid.of_rows(rows.withColumnRenamed(id_col, "_order"), "_order", id_col=id_col)
    cells = written(grid.unfolded(), "grid").withColumnRenamed("target", "task")
    split, skipped = S.split_every_task(cells, id_col, **options)
    return grid.with_texts(split), skipped


def build_levels(df, id_col, use_groups=False):
    """Severity rows as tasks of their own, named `<target>#level`, so they never mix with the 0/1 rows."""
    rows = df.select(id_col, "text", "target", "level", *(["group"] if use_groups else []))
    written_as = F.coalesce("group" if use_groups else "target", F.lit("Other"))
    rows = comment_targets(rows.withColumn("value", severity_label(written_as, F.col("level"))), use_groups)
    return rows.select(id_col, "text", F.concat("target", F.lit("#level")).alias("task"), "value")


def build_wide(df, order, tasks=None, use_groups=False):
    """One row per text and one column per target, from the first row of each text."""
    return R.long_to_wide_unique(comment_targets(df, use_groups), "text", order, tasks, task="target")


def build_votes(annotations, key, flags, ordinal, text="text"):
    """One row per comment: majority of its annotators, flags merged by group, a general flag."""
    votes = L.majority_vote(annotations, key, [*flags, ordinal], flags)
    merged = L.collapse_flag_groups(votes, flags, keep=[key, ordinal], general="contains_hate")
    return L.attach_text(merged, annotations, key, text)


def build_nested(corpus):
    """Long rows of a nested corpus: the general task from the gold answer, then one task per known type."""
    typed = L.with_types(corpus).withColumnRenamed("content", "text")
    grid = Grid.of_types(typed, "comment_id", ["text"])
    general = typed.select(
        "comment_id",
        "text",
        F.lit(GENERAL_TASK).alias("target"),
        label_from_value(F.col("found_manipulation"), "yes").alias("value"),
    )
    return general.unionByName(grid.with_texts(grid.unfolded()))


def build_suite(cases, mapping, positive="hateful"):
    """Long rows of a functional test suite (test_case, target_ident, label_gold): mapped target and general task."""
    tasks = [
        (map_values(F.col("target_ident"), mapping), F.lit(1)),
        (F.lit("contains_hate"), label_from_value(F.col("label_gold"), positive)),
    ]
    rows = R.stack_tasks(cases.withColumnRenamed("test_case", "text"), ["text"], tasks)
    return rows.where(F.col("task").isNotNull())


def written_splits(rows, id_col, path, ratio=None, seed=42):
    """(path of the split table, skipped tasks): long rows split task by task and written to task and split directories."""
    split, skipped = S.split_every_task(rows, id_col, ratio=ratio, seed=seed)
    return write_splits(split, path), skipped


def written_votes(annotations, key, flags, ordinal, path, text="text", extra=None):
    """Annotations to written splits: votes, one row per task, extra rows, stratified split."""
    wide = build_votes(annotations, key, flags, ordinal, text).drop(ordinal)
    rows = R.wide_to_long(wide, [key, text])
    rows = rows if extra is None else rows.unionByName(extra)
    return written_splits(rows.where(F.col("value").isNotNull()), key, path)


def written_wide(df, order, path, tasks=None, seed=42):
    """Comment rows to a written wide table with a random split per text."""
    wide = build_wide(df, order, tasks).withColumn("text_md5", F.md5("text"))
    split = S.random_split(wide, "text_md5", seed=seed)
    split.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def generated_rows(records, labelled, names, k=2):
    """Generated records (label names as they come) to long extra rows (text, task, value): labels of the source text, first texts, groups renamed.

    `records` has original_comment and generated_comments, `labelled` text and labels (an array), `names` task and base_task.
    """
    texts = text_list(F.col("generated_comments"))
    chosen = records.select("original_comment", F.lit(None).alias("labels"), first_k(texts, k).alias("selected"))
    relabelled = L.relabel_generated(chosen, labelled)
    rows = R.explode_generated(relabelled.select("selected", "labels")).withColumnRenamed("target", "task")
    return L.rename_groups(rows.where(F.col("task").isNotNull()), names).withColumn("value", F.lit(1))
