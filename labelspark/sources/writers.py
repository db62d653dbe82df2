"""Writing label tables, splits, class maps and reports."""

from pyspark.sql import functions as F

from labelspark.operators.lookup import lookup_join


def write_task_partitions(df, path, task="task"):
    """Parquet with one directory per task; a directory name keeps any task name."""
    df.write.mode("overwrite").partitionBy(task).parquet(path)
    return path


def write_wide(df, path):
    """The wide table as parquet, and as CSV from that parquet: the plan of `df` runs once."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    rows = df.sparkSession.read.parquet(f"{path}.parquet")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}.csv")
    return path


def write_splits(df, path, rows_per_file=1_000_000):
    """Parquet with one directory per task and split, and about `rows_per_file` rows per file, whatever the number of tasks.

    Rows are dealt to as many salts as their directory needs files.
    """
    keys = ["task", "split"]
    files = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).cast("int").alias("_files"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.col("_files"))
    dealt = lookup_join(df, files, keys).withColumn("_salt", salt).repartition(*keys, "_salt")
    dealt.select(*df.columns).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return path


def replace_tasks(df, path):
    """Replaces only the task and split directories that `df` has rows for."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("task", "split").parquet(path)
    return path


def save_class_maps(classes, path):
    """Class maps are small: one file beside the model."""
    classes.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def write_report(df, path, sep=","):
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path
