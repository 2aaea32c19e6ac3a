"""Streams: named channels of typed elements, and zonal means accumulated over steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def open_channel(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 64) -> DataFrame:
    """A channel is a folder of Parquet files; a reader gets each file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def send(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def of_type(elements: DataFrame, kind: str) -> DataFrame:
    """Elements of one of the types C, I, R and D, cast to it."""
    to = {"C": "string", "I": "int", "R": "float", "D": "double"}[kind]
    return elements.where(F.col("kind") == kind).withColumn("value", F.col("value").cast(to))


def zonal_means(rows: DataFrame, at: str, value: str, zone, length: str, late: str) -> DataFrame:
    """Count and mean of each zone over windows of time.  A row later than the watermark is dropped."""
    return (
        rows.withWatermark(at, late)
        .groupBy(F.window(at, length), zone.alias("zone"))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("start"), "zone", "n", "mean")
    )


def open_windows(sent: DataFrame, at: str, value: str, zone, length: str, late: str) -> DataFrame:
    """What zonal_means() has not closed yet of the rows sent: the windows that end after the latest time less the delay.

    With what the stream has written, that is the whole of a channel that nothing more is sent to.
    """
    latest = sent.agg((F.max(at) - F.expr(f"INTERVAL {late}")).alias("_until"))
    means = sent.groupBy(F.window(at, length), zone.alias("zone")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    left = means.join(F.broadcast(latest), F.col("window.end") > F.col("_until"))  # latest is one row
    return left.select(F.col("window.start").alias("start"), "zone", "n", "mean")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and stop; restarted with the same checkpoint, it goes on where it stopped."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").start(path).awaitTermination()
