"""Station-day sums of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_sums(events: DataFrame, station: str = "user_id", time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """``station, day, total, n``: tumbling windows of a day; what comes later than ``late`` is dropped by the watermark."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    sums = stamped.groupBy(F.window("_at", "1 day").alias("w"), F.col(station).alias("station")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select("station", F.to_date("w.start").alias("day"), "total", "n")


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Appends finished days to Parquet once all input so far is read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
