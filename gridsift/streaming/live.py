"""Live reports: windows over event time, duplicates within the watermark, and overview counts kept up to date.

Each function takes a streaming or a static DataFrame of events(event_id, ts, user_id, event_type, value); on a
static one it gives what the stream gives in the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "1 hour"


def events_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _late(events: DataFrame) -> DataFrame:
    """A stream with its watermark, which needs time stamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Reports and their mean value by type in windows that follow each other."""
    out = _late(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    """Reports in windows that overlap."""
    return _late(events).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """A user's reports that follow each other within the gap."""
    out = _late(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One report of each key; a stream forgets keys after the watermark."""
    return _late(events).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def overview(cells: DataFrame, block: int) -> DataFrame:
    """Counts, sums and ranges of classified cells(r, c, zc, slope, ground) by block; partial sums merge as cells arrive.

    A stream keeps one row per block in its state; means follow from sums, so the order of arrival does not matter.
    """
    known = F.col("ground") != 255
    per = cells.groupBy(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(known).alias("valid"), F.sum(F.when(known, F.col("slope"))).alias("slope_sum"), F.count(F.when(known, F.col("slope"))).alias("slope_n"),
        F.min("zc").alias("low"), F.max("zc").alias("high"), F.count_if(F.col("ground").isin(1, 2)).alias("passing"),
    )
    return per.select("br", "bc", "cells", "valid", "passing", (F.col("slope_sum") / F.col("slope_n")).alias("slope_mean"), (F.col("high") - F.col("low")).alias("elev_range"))


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, batch by batch, remembering in checkpoint what is done."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
