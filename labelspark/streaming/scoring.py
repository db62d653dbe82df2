"""Scoring texts as they arrive: clean, predict, append. Nothing is kept between batches."""

from pyspark.sql import functions as F

from labelspark.functions.clean import clean_text


def text_stream(spark, path, schema):
    """Parquet files of a folder, or one file, as a stream."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place)
    reader = spark.readStream.schema(schema)
    if status.isFile():
        # a stream's path is a folder: the file is named by a filter
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def score_stream(stream, score, text="text"):
    """`score` is a row-wise DataFrame function, such as the transform of a fitted model."""
    return score(stream.withColumn(text, clean_text(F.col(text))))


def write_stream(scored, path, checkpoint):
    """Appends everything that has arrived to a parquet table and ends; a restart goes on where it stopped."""
    query = (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
