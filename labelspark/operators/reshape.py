"""Long and wide label tables, stacked tasks, exploded generated rows."""

from pyspark.sql import functions as F

from labelspark.operators.lookup import union_all


#: A pivot makes one column per task; more tasks than this are an error unless the caller lists them or sets another bound.
PIVOT_COLUMNS = 10_000


def task_names(df, task="task", bound=PIVOT_COLUMNS):
    """Sorted task names for a pivot: column names, so they come to the driver."""
    rows = df.select(task).where(F.col(task).isNotNull()).distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} distinct values in {task} for one column each; list the tasks or keep the long form")
    return sorted(row[0] for row in rows)


def wide_to_long(df, keys, tasks=None):
    """One row per key and task, from every other column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    tasks = tasks or [c for c in df.columns if c not in keys]
    return df.unpivot(keys, tasks, "task", "value")


def long_to_wide_unique(df, key, order, tasks=None, task="task", fill=0):
    """One column per task from the first row of each key in `order`; gaps are filled."""
    tasks = tasks or task_names(df, task)
    # the hash comes first so that sorting long texts compares eight bytes
    first = df.groupBy(F.xxhash64(key).alias("_h"), key).agg(F.min_by(F.struct(task, "value"), F.col(order)).alias("_f"))
    return first.select(
        key, *[F.coalesce(F.when(F.col(f"_f.{task}") == t, F.col("_f.value")), F.lit(fill)).alias(t) for t in tasks]
    )


def long_to_wide_keyed(df, keys, tasks=None, task="task", fill=0):
    """One column per task; two rows for one key and task are an error, gaps are filled."""
    tasks = tasks or task_names(df, task)
    one = [F.max(F.when(F.col(task) == t, F.col("value"))).alias(t) for t in tasks]
    rows = [F.count_if(F.col(task) == t) for t in tasks]
    wide = df.groupBy(*keys).agg(*one, F.greatest(*rows, F.lit(0)).alias("_rows"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("duplicate rows for key"), *[F.col(k).cast("string") for k in keys]))
    kind = df.schema["value"].dataType
    return wide.select(
        *keys,
        *[F.when(F.col("_rows") > 1, lost.cast(kind)).otherwise(F.coalesce(t, F.lit(fill))).alias(t) for t in tasks],
    )


def long_to_wide_mean(df, key, tasks=None, task="task", fill=0):
    """One column per task with the mean of duplicate rows; null tasks are left out, gaps are filled."""
    known = df.where(F.col(task).isNotNull())
    tasks = tasks or task_names(known, task)
    return known.groupBy(key).pivot(task, tasks).agg(F.avg("value")).na.fill(float(fill), tasks)


def stack_tasks(df, keep, tasks):
    """One row per input row and derived task, in a single scan; `tasks` is [(task column, value column)]."""
    pairs = [F.struct(name.alias("task"), value.cast("int").alias("value")) for name, value in tasks]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.task", "_p.value")


def explode_generated(df, texts="selected", labels="labels", keep_empty=False):
    """One row per generated text and label; an empty text list gives a null row only on request."""
    rows = df.withColumn("text", F.explode_outer(texts)).drop(texts)
    if not keep_empty:
        rows = rows.where(F.col("text").isNotNull())
    return rows.withColumn("target", F.explode_outer(labels)).drop(labels)


def product_rows(df, keep=(), texts="generated_comments", labels="labels"):
    """Generated texts times labels, value 1; without a label one row with a null target and value 0."""
    none = F.array(F.lit(None).cast("string"))
    rows = df.select(*keep, F.explode(texts).alias("text"), F.col(labels).alias("_l"))
    targets = F.when(F.size("_l") > 0, F.col("_l")).otherwise(none)
    rows = rows.select(*keep, "text", F.explode(targets).alias("target"))
    return rows.withColumn("value", F.col("target").isNotNull().cast("int"))


def append_rows(base, extra):
    """UNION ALL by name."""
    return base.unionByName(extra)


def concat_groups(frames):
    """UNION ALL by name of many tables."""
    return union_all(frames)


def drop_duplicate_text(df, key, order):
    """First row per key in `order`; copies are folded before they are shuffled."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(F.xxhash64(key).alias("_h"), key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f"))
    return first.select(key, "_f.*").select(*df.columns)


def remaining(tasks, finished, key="task"):
    """Tasks that have no result yet."""
    return tasks.join(finished.select(key).distinct(), key, "left_anti")
