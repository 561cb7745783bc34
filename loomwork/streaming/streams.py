"""Streams: files that keep arriving as a DataFrame, windowed aggregates with late data, and running queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", most_files: int | None = None) -> DataFrame:
    """Rows of the files that appear in a folder."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def windowed(df: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Aggregates by window and keys; rows later than ``late`` behind the newest are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = df.withWatermark(time, late).groupBy(window.alias("window"), *(keys or [])).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in grouped.columns if c != "window"))


def sessions(df: DataFrame, time: str, gap: str, aggregates: list[Column], keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Aggregates by sessions of keys, which end after a gap."""
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in grouped.columns if c != "window"))


def without_repeats(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class Stream:
    """A running query: whether it is active, how many rows it has read, waiting and stopping."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    @classmethod
    def start(cls, df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, mode: str = "append") -> Stream:
        """Each micro-batch goes to ``sink(batch, number)``; ``checkpoint`` is a folder that all executors share."""
        return cls(df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())

    @property
    def is_active(self) -> bool:
        return self.query.isActive

    @property
    def rows_read(self) -> int:
        return sum(p["numInputRows"] for p in self.query.recentProgress)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the query ended within the time."""
        return self.query.awaitTermination(seconds) if seconds is not None else self.query.awaitTermination() is None

    def stop(self) -> None:
        self.query.stop()
