"""Incremental evidence: deduplication and windows over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, time: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, time: str, by: Sequence[str], value: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums in event-time windows; late events within the delay are counted."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    agg = stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def upsert_sink(path: str, keys: Sequence[str], order: Sequence[str]):
    """A foreachBatch function that appends the rows of keys that the table doesn't have yet."""

    def write(batch: DataFrame, _: int) -> None:
        from nadir.operators.pairs import first_per_group

        fresh = first_per_group(batch, list(keys), list(order))
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
