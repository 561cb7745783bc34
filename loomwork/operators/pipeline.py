"""Transforms, chains of them, and pipelines: one lazy plan and one action, with statistics and cancelling."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import EngineError, InvalidArgument


class Transform:
    """A step from DataFrame to DataFrame. ``keeps_order`` and ``parallel`` say what callers may rely on."""

    keeps_order = True
    parallel = True

    def __init__(self, function: Callable[[DataFrame], DataFrame] | None = None, keeps_order: bool = True):
        self.function, self.keeps_order = function, keeps_order

    def apply(self, df: DataFrame) -> DataFrame:
        return self.function(df) if self.function else df

    def output_schema(self, schema: T.StructType, spark: SparkSession) -> T.StructType:
        """The schema that comes out for one that goes in; nothing is run."""
        return self.apply(spark.createDataFrame([], schema)).schema


class BatchTransform(Transform):
    """A function of Arrow batches, which may change how many rows there are; one task if it isn't parallel."""

    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, parallel: bool = True):
        super().__init__()
        self.batches, self.schema, self.parallel = function, schema, parallel

    def apply(self, df: DataFrame) -> DataFrame:
        return (df if self.parallel else df.coalesce(1)).mapInArrow(self.batches, self.schema)


class Chain(Transform):
    """Transforms one after the other."""

    def __init__(self, steps: list[Transform] | None = None):
        super().__init__()
        self.steps = list(steps or [])

    def add(self, step: Transform) -> Chain:
        return Chain([*self.steps, step])

    @property
    def keeps_order(self) -> bool:
        return all(s.keeps_order for s in self.steps)

    @keeps_order.setter
    def keeps_order(self, value: bool) -> None:
        """The steps decide."""

    @property
    def parallel(self) -> bool:
        return all(s.parallel for s in self.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step.apply)
        return df


@dataclass
class Settings:
    """What a run is tuned by, as Spark's own settings. Buffers, threads and backpressure are Spark's business: tasks pull
    batch by batch, and sorts, joins and aggregates spill when their share of memory is used up."""

    batch_rows: int = 10_000
    partitions: int | None = None
    split_bytes: int | None = None

    def apply(self, spark: SparkSession) -> None:
        if self.batch_rows < 1 or (self.partitions or 1) < 1:
            raise InvalidArgument("sizes are positive")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", self.batch_rows)
        if self.partitions:
            spark.conf.set("spark.sql.shuffle.partitions", self.partitions)
        if self.split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", self.split_bytes)


@dataclass
class Statistics:
    """What a run did. Times are the driver's: planning, and the one action."""

    rows_in: int = 0
    rows_out: int = 0
    plan_seconds: float = 0.0
    run_seconds: float = 0.0


class Cancelled(EngineError):
    """The run was cancelled from another thread."""


class Pipeline:
    """source() -> transform -> sink(DataFrame). The sink runs the one action."""

    def __init__(self, source: Callable[[], DataFrame] | DataFrame, transform: Transform, sink: Callable[[DataFrame], object], settings: Settings | None = None):
        if not callable(sink):
            raise InvalidArgument("a sink is a function of a DataFrame")
        self.source, self.transform, self.sink, self.settings = source, transform, sink, settings
        self.tag = f"pipeline-{uuid.uuid4().hex}"
        self.statistics = Statistics()
        self._session: SparkSession | None = None
        self._stopped = False

    def run(self) -> object:
        """What the sink returns."""
        if self._stopped:
            raise Cancelled(self.tag)
        began = time.perf_counter()
        df = self.source() if callable(self.source) else self.source
        self._session = df.sparkSession
        if self.settings is not None:
            self.settings.apply(self._session)
        before, after = Observation(f"{self.tag}-in"), Observation(f"{self.tag}-out")
        watched = self.transform.apply(df.observe(before, F.count(F.lit(1)).alias("rows"))).observe(after, F.count(F.lit(1)).alias("rows"))
        planned = time.perf_counter()
        self._session.addTag(self.tag)
        try:
            result = self.sink(watched)
        except Exception as error:
            if self._stopped:
                raise Cancelled(self.tag) from error
            raise
        finally:
            self._session.removeTag(self.tag)
        self.statistics = Statistics(before.get["rows"], after.get["rows"], planned - began, time.perf_counter() - planned)
        return result

    def cancel(self) -> None:
        """Stop the run from another thread; a pipeline that is cancelled doesn't run again."""
        self._stopped = True
        if self._session is not None:
            self._session.interruptTag(self.tag)
