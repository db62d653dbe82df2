"""From annotations to label tables: votes, frequent targets, grids, class maps and weights."""

from pyspark.sql import Window as W, functions as F

from labelspark.functions.columns import any_flag, flag_groups
from labelspark.operators.lookup import lookup_join, pair_all


def select_by_prefix(df, prefix, keep=()):
    """The kept columns and every column whose name starts with the prefix."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def majority_vote(df, key, columns, flags=()):
    """Most frequent value per key and column; the smallest value wins a tie, nulls do not vote.

    Columns named in `flags` hold 0/1 (or booleans) and need only their ones counted.
    """

    def vote(c):
        if c in flags:
            one = F.col(c).cast("int")
            return F.when(F.count(one) > 0, (2 * F.sum(one) > F.count(one)).cast("int"))
        return F.mode(c, deterministic=True)

    return df.groupBy(key).agg(*[vote(c).alias(c) for c in columns])


def attach_text(votes, raw, key, text="text"):
    """Joins the distinct texts of the raw table to the settled labels."""
    return raw.select(key, text).distinct().join(votes, key)


def collapse_flag_groups(df, columns, keep=(), general=None):
    """One 0/1 column per flag group, and `general` = 1 when any group is set."""
    groups = flag_groups(columns)
    merged = df.select(*keep, *[any_flag(members).alias(name) for name, members in groups.items()])
    return merged.withColumn(general, any_flag(list(groups))) if general else merged


def target_counts(df, target="target"):
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def keep_frequent_targets(df, target="target", more_than=5):
    """Rows of targets with more than `more_than` rows."""
    frequent = target_counts(df, target).where(F.col("n") > more_than).select(target)
    return lookup_join(df, frequent, target, "left_semi")


def complete_grid(df, text="text", target="target"):
    """Every distinct text with every distinct target, value 0."""
    return pair_all(df.select(text).distinct(), df.select(target), target).withColumn("value", F.lit(0))


def overlay_values(grid, df, order, text="text", target="target"):
    """Grid values replaced by the last non-zero value of the same text and target, in `order`.

    Only hashes of text and target meet: two 64-bit ones, so that texts stay where they are.
    """
    hashes = {"_h": F.xxhash64(text, target), "_g": F.xxhash64(F.lit("g"), target, text)}
    marked = df.where(F.col("value") != 0).withColumns(hashes)
    known = marked.groupBy("_h", "_g").agg(F.max_by("value", order).alias("_v"))
    rows = lookup_join(grid.withColumns(hashes), known, ["_h", "_g"], "left")
    return rows.withColumn("value", F.coalesce(F.col("_v"), F.col("value"))).drop("_v", "_h", "_g")


def completed_values(df, order, text="text", target="target"):
    """The grid and its values in one step: each text meets the targets once, with its own values at hand.

    Same rows as `overlay_values(complete_grid(df), df, order)`, without moving a text once per target.
    """
    marked = df.withColumn("_h", F.xxhash64(text)).withColumn("_o", F.when(F.col("value") != 0, F.col(order)))
    last = marked.groupBy("_h", text, target).agg(F.max_by("value", "_o").alias("_v"))
    own = F.collect_list(F.when(F.col("_v").isNotNull(), F.struct(target, "_v")))
    texts = last.groupBy("_h", text).agg(F.map_from_entries(own).alias("_m")).drop("_h")
    pairs = pair_all(texts, df.select(target), target)
    return pairs.select(text, target, F.coalesce(F.try_element_at("_m", F.col(target)), F.lit(0)).alias("value"))


def with_types(df, annotations="annotations", field="technique"):
    """Adds `types`: the sorted distinct annotation types of the row, empty when there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.col(annotations), lambda a: a[field])))
    return df.withColumn("types", F.coalesce(found, F.array().cast("array<string>")))


def distinct_types(df):
    """All types that occur, from a table with `types`."""
    return df.select(F.explode("types").alias("target")).distinct()


def expand_types(df, keep, types="types"):
    """Every row with every known type, value 1 where the row has the type."""
    pairs = pair_all(df.select(*keep, types), distinct_types(df), "target")
    return pairs.select(*keep, "target", F.array_contains(F.col(types), F.col("target")).cast("int").alias("value"))


def relabel_generated(generated, labelled, text="text", original="original_comment"):
    """Generated rows take the labels of their source text, once per source row; rows without a source are left out.

    Texts are not compared or sorted: two 64-bit hashes stand for them.
    """
    source = labelled.where(F.col(text).isNotNull()).select(*_text_hashes(text), "labels")
    return generated.drop("labels").withColumns({"_h": _text_hashes(original)[0], "_g": _text_hashes(original)[1]}).join(source, ["_h", "_g"]).drop("_h", "_g")


def unmatched_generated(generated, labelled, text="text", original="original_comment"):
    """(original, n): the generated rows that `relabel_generated` leaves out, counted by their source text, a missing one as null."""
    first, second = _text_hashes(original)
    counted = generated.groupBy(original).agg(F.count(F.lit(1)).alias("n")).withColumns({"_h": first, "_g": second})
    source = labelled.where(F.col(text).isNotNull()).select(*_text_hashes(text)).distinct()
    return counted.join(source, ["_h", "_g"], "left_anti").drop("_h", "_g")


def _text_hashes(c):
    """Two hashes of a text; a missing text has none and meets nothing."""
    known = F.col(c).isNotNull()
    return F.when(known, F.xxhash64(c)).alias("_h"), F.when(known, F.xxhash64(F.lit("g"), c)).alias("_g")


def only_known_tasks(extra, base_tasks, task="task"):
    """(rows whose task the base has, tasks that are left out with their row counts)"""
    known = base_tasks.select(task).distinct()
    kept = lookup_join(extra, known, task, "left_semi")
    skipped = lookup_join(extra, known, task, "left_anti").groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    return kept, skipped


def rename_groups(df, names, task="task"):
    """Task names replaced by the second column of `names` (task, base_task); others stay."""
    renamed = lookup_join(df, names, task, "left")
    return renamed.withColumn(task, F.coalesce("base_task", task)).drop("base_task")


def class_counts(df, task="task", label="value"):
    """Rows per class, and the smallest class of the task (the first one on a tie)."""
    counts = df.groupBy(task, label).agg(F.count(F.lit(1)).alias("n"))
    minority = counts.groupBy(task).agg(F.min_by(label, F.struct("n", label)).alias("minority"))
    return counts.join(minority, task)


def class_weights(df, task="task", label="value"):
    """Balanced weight rows / (classes * rows of the class)."""
    counts = df.groupBy(task, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(task).agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weight = F.col("_all") / (F.col("_classes") * F.col("n"))
    return counts.join(totals, task).select(task, label, weight.cast("double").alias("weight"))


def class_map(df, task="task", label="value"):
    """Sorted labels of each task numbered from 0."""
    order = W.partitionBy(task).orderBy(label)
    return df.select(task, label).distinct().withColumn("idx", F.row_number().over(order) - 1)


def task_index(classes, task="task"):
    """Tasks numbered from 0 by name."""
    order = W.partitionBy(F.lit(0)).orderBy(task)
    return classes.select(task).distinct().withColumn("task_idx", F.row_number().over(order) - 1)


def encode_labels(df, classes, on_missing="warn", task="task", label="value"):
    """Adds `task_idx` and `label_idx`.

    A task without a class map is an error, or keeps null indexes ('warn', 'ignore'). A label the
    map of a known task lacks is always an error.
    """
    if on_missing not in ("error", "warn", "ignore"):
        raise ValueError("on_missing is one of 'error', 'warn', 'ignore'")
    lookup = classes.select(task, label, F.col("idx").alias("label_idx"))
    coded = lookup_join(lookup_join(df, task_index(classes, task), task, "left"), lookup, [task, label], "left")
    unknown_label = F.col("task_idx").isNotNull() & F.col("label_idx").isNull()
    lost = F.raise_error(F.concat(F.lit("no class for label "), F.col(label).cast("string"), F.lit(" of "), F.col(task)))
    coded = coded.withColumn("label_idx", F.when(unknown_label, lost.cast("int")).otherwise(F.col("label_idx")))
    if on_missing == "error":
        lost = F.raise_error(F.concat(F.lit("class map has no task "), F.col(task)))
        coded = coded.withColumn("task_idx", F.when(F.col("task_idx").isNull(), lost.cast("int")).otherwise(F.col("task_idx")))
    return coded


def encode_wide(df, classes, columns, task="task", label="value"):
    """Adds `labels`: the class index of every label column, in the order of `columns`; null without one."""
    coded = df
    for i, c in enumerate(columns):
        own = classes.where(F.col(task) == c)
        own = own.select(F.col(label).cast(df.schema[c].dataType).alias(c), F.col("idx").alias(f"_i{i}"))
        coded = lookup_join(coded, own, c, "left")
    return coded.select(*df.columns, F.array(*[f"_i{i}" for i in range(len(columns))]).alias("labels"))


def unknown_tasks(df, classes, task="task"):
    """The report behind 'warn': tasks without a class map, with row counts."""
    counts = df.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(classes.select(task).distinct(), task, "left_anti")


def decode_labels(df, classes, task="task", label="value", idx="predicted"):
    """Adds `predicted_label`, the class name behind a class index."""
    names = classes.select(task, F.col("idx").cast("int").alias(idx), F.col(label).alias("predicted_label"))
    return lookup_join(df, names, [task, idx], "left")


def label_totals(df, columns):
    """Column sums as (target, total)."""
    sums = df.agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])
    return sums.unpivot([], list(columns), "target", "total")


def cast_label_type(df, base_type, label="value"):
    """Casts the label to the base table's type; a value that does not survive the cast is an error."""
    cast = F.col(label).try_cast(base_type)
    lost = F.raise_error(F.concat(F.lit("label does not fit the base type: "), F.col(label).cast("string")))
    broken = F.col(label).isNotNull() & cast.isNull()
    return df.withColumn(label, F.when(broken, lost.cast(base_type)).otherwise(cast))
