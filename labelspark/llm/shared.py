"""Helpers of this subpackage: the package for the executors, batches of texts, broadcasts of a checked size."""

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from labelspark.session import shared_folder


def ship(spark):
    """Sends this package to the executors once per context; tasks then import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_labelspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="labelspark-"), f"labelspark_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("labelspark", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._labelspark_shipped = True


def stored(df, name, compression="zstd"):
    """The same rows, from Parquet in the shared folder: a lost executor costs no earlier work."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def noted(df, name, compression="zstd", **facts):
    """`stored` rows and a dictionary of aggregates over them, taken while they are written: no job of their own."""
    watch = Observation()
    rows = stored(df.observe(watch, *[fact.alias(key) for key, fact in facts.items()]), name, compression)
    values = watch.get
    if set(values) != set(facts):  # the engine left the observation out of a plan without rows
        values = rows.agg(*[fact.alias(key) for key, fact in facts.items()]).first().asDict()
    return rows, values


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def parts(batches, rows=2048):
    """Record batches cut to `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def per_batch(function, schema):
    """`mapInArrow` argument: `function(columns as Python lists) -> columns as lists or arrays`, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in parts(batches):
            got = function({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=False) for f in fields], schema=fields)

    return run


def slices(texts, chars=1 << 20):
    """Index ranges of `texts` that hold about `chars` characters each, one text at least."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def buckets_of(text, parts):
    """crc32 of the text of a column, modulo `parts`: the folds of the queries."""
    return F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")) % parts
