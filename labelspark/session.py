"""Session settings for local runs; on a cluster the submitted configuration is used as it is."""

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus=None, app="labelspark"):
    """Session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark):
    """Sends this package to the executors once per context; tasks then import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_labelspark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="labelspark-"), f"labelspark_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("labelspark", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._labelspark_shipped = True


@contextlib.contextmanager
def small_batches(spark, rows):
    """Jobs started inside give their Python functions at most `rows` rows at a time: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def shared_folder(spark, name):
    """A new path below the folder all executors share (`spark.checkpoint.dir`).

    Only a local session without that setting gets a folder of its own machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="labelspark-")
    return f"{base.rstrip('/')}/labelspark/{name}-{uuid.uuid4().hex}"


def written(df, name):
    """The same rows, from a table written once to the shared folder: later jobs start from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
