"""Records as a stream: the last record of each key, and time windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by event-time windows, batch or stream; late rows beyond `late` drop from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_of(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key so far."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def run_to_end(spark: SparkSession, stream: DataFrame, checkpoint: str, out: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what there is and return the last batch's rows."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
