"""Scored results that keep arriving: one current row per sample, and running totals by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import BucketStore


def read_results(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """A stream of Parquet result files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str = "sample_id", pos: str = "pos", buckets: int = 64) -> StreamingQuery:
    """Keeps one row per key under ``target``, the newest, in a ``BucketStore``: a batch rewrites the buckets it touches.

    A batch that dies changes nothing, and one that runs twice gives the same table: its version is the batch's number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        BucketStore(batch.sparkSession, target, key, pos, buckets).put(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version, or None before the first. Any failure but a missing path is raised."""
    return BucketStore(spark, target).current()


def windowed_activity(events: DataFrame, width: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Events, speakers' seconds by type and window, dropped from state once ``late`` has passed; batch or stream."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("centis")).select(F.col("w.start").alias("window_start"), "event_type", "n", "centis")
