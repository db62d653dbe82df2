"""Nearest-centroid head on vector columns."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelspark.session import ship

#: Vectors multiplied at a time.
ROWS = 4096


def centroids(df, vector="embedding", label="label"):
    """Mean vector per label; vectors without a label have none."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(vector)))
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(mean.alias("centroid"))


def nearest_centroid(df, means, id_col, vector="embedding", label="label", cells=4_000_000):
    """(id, predicted, cosine): the label of the most similar mean; the smaller label wins a tie.

    The means travel to all executors as a matrix of unit rows, `cells` numbers at most; blocks of vectors are multiplied with it, and
    only the best label of a vector leaves the block. A vector or a mean of length zero has no direction: its cosine is null, and only a row
    without any other has a null cosine and the smallest label.
    """
    spark = df.sparkSession
    ship(spark)
    wide = F.size("centroid")
    n = means.agg(F.sum(wide)).first()[0] or 0
    if n > cells:
        raise ValueError(f"means of {n} numbers; the bound is {cells}")
    listed = means.select(F.col(label).alias("l"), F.col("centroid").cast("array<double>").alias("m")).orderBy(F.asc_nulls_first("l")).collect()
    rows = df.select(id_col, F.col(vector).cast("array<double>").alias("_x"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("predicted", means.schema[label].dataType), T.StructField("cosine", T.DoubleType())])
    fields = to_arrow_schema(schema)
    names = [r["l"] for r in listed]
    table = np.array([r["m"] for r in listed], float)
    length = np.sqrt((table * table).sum(axis=1, keepdims=True)) if len(listed) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((np.divide(table, length, out=np.zeros_like(table), where=length > 0), length[:, 0] > 0))

    def run(batches):
        unit, real = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                fits = pc.equal(pc.fill_null(pc.list_value_length(batch.column(1)), -1), unit.shape[1])
                x = np.zeros((batch.num_rows, unit.shape[1]))
                own = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
                x[own] = batch.column(1).filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                size = np.sqrt((x * x).sum(axis=1))
                known = size > 0
                cosine = np.where(known[:, None] & real[None, :], x @ unit.T / np.where(known, size, 1)[:, None], -2.0)
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(best)), best]
                found = pa.array([names[k] for k in best], fields.field(1).type)
                yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array(top, pa.float64(), mask=~(top > -2))], schema=fields)

    return rows.mapInArrow(run, schema) if listed else spark.createDataFrame([], schema)
