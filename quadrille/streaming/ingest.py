"""Documents and events as streams, through the same operators as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, key: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by key and window, with a watermark for late rows."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def into(stream: DataFrame, pipeline, path: str, checkpoint: str):
    """A query that writes pipeline(batch) to a folder for each batch; a batch that is run again replaces itself."""

    def write(batch: DataFrame, no: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{path}/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
