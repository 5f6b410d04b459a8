"""Structured Streaming twins of the window operators; each equals its batch form once the stream is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a Parquet file or folder as a stream, ts as a timestamp."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a stream takes no single file


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    at = new_path(spark, "stream/run")
    save = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")  # noqa: E731  complete mode: each batch is the whole result
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{at}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def tumbling(events: DataFrame, time: str, width: str) -> DataFrame:
    """Counts and sums by tumbling window and type."""
    w = events.withWatermark(time, "1 hour").groupBy(F.window(time, width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Session windows by key: start, end (last event plus gap), n."""
    w = events.withWatermark(time, "1 hour").groupBy(F.session_window(time, gap).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def drained_rows(stream: DataFrame) -> DataFrame:
    """Like drained, for streams that append: the rows of all batches."""
    spark = stream.sparkSession
    at = new_path(spark, "stream/run")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def usage(events: DataFrame, kind: str, amount: str) -> DataFrame:
    """Running totals of an append-only log by kind."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("calls"), F.sum(amount).alias("total"))


def distinct_chunks(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows of overlapping chunks once each: later copies within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
