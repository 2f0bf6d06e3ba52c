"""Streams: new files and new events go into the tables as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators import markdown


def watch_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """A stream of (file_path, content, modified): each file once, when it appears."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def index_as_they_come(files: DataFrame, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = markdown.sections) -> StreamingQuery:
    """Each micro-batch's files are extracted into a folder of its own; a batch that is tried again overwrites what it wrote."""

    def write(batch: DataFrame, epoch: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """Of what index_as_they_come wrote: each file as of the last epoch that had it."""
    last = table.groupBy("file_path").agg(F.max("epoch").alias("epoch"))
    return table.join(last, ["file_path", "epoch"], "left_semi")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with a watermark; the same plan runs over a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
