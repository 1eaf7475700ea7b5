"""Refreshing a table from files as they arrive, and finite streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.sources.files import forget, kept
from cinegraph.sources.layout import Table


def refresh(spark: SparkSession, folder: str, table: Table, checkpoint: str):
    """A file stream whose batches upsert into a laid-out table; ends when all files are taken.

    Of a key's rows in several files the last file's count, by time and name; a file that has a key twice is an error, as
    it is in a load. A version says which batch made it, so a batch that is run again changes nothing. Each batch
    rewrites the buckets that it touches, and no others.
    """
    layout = table.layout

    def step(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*layout.keys).agg(F.max("_from").alias("_last")).select(*(F.col(k).alias(f"_{k}") for k in layout.keys), "_last")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in layout.keys] + [F.col("_from") == F.col("_last")]
        latest = kept(batch.join(last, same, "left_semi").select(*layout.schema.names))
        table.upsert(latest, number)
        forget(latest)

    files = spark.readStream.schema(layout.schema).parquet(folder).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_from"))
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """The rows that a stream gives of all that is there when it starts, written to a folder and read again."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def pages(df: DataFrame, size: int):
    """The rows of a finite result in lists of at most size, without holding all of them."""
    page = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def appended(streams: list[DataFrame], folder: str) -> DataFrame:
    """The rows of finite streams one after the other: each row with the number of its stream, from 0, in _stream.

    A stream begins when the one before has ended; its checkpoint is in a folder of its number, so after a failure the
    same call goes on with the stream that was broken off, and none is taken twice. Streams need the same columns.
    """
    spark, schema = streams[0].sparkSession, streams[0].schema
    for i, stream in enumerate(streams):
        rows = stream.select(*schema.names)
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoints/{i}").trigger(availableNow=True).start(f"{folder}/rows/_stream={i}")
        query.awaitTermination()
    parts = [spark.read.schema(schema).parquet(f"{folder}/rows/_stream={i}").withColumn("_stream", F.lit(i)) for i in range(len(streams))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
