"""Taking up where an earlier run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key is not done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def coverage(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(side, key): keys wanted but not done, and done but not wanted."""
    w, d = wanted.select(key).where(F.col(key).isNotNull()).distinct(), done.select(key).where(F.col(key).isNotNull()).distinct()
    missing = w.join(d, key, "left_anti").select(F.lit("missing").alias("side"), key)
    return missing.unionByName(d.join(w, key, "left_anti").select(F.lit("extra").alias("side"), key))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, late: str) -> StreamingQuery:
    """Append a stream's rows to a table, each key once within the watermark, over restarts."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
