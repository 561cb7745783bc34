"""A dataset: a lazy DataFrame with metadata of its own, and a builder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from loomwork.errors import InvalidArgument
from loomwork.operators import rows
from loomwork.operators.predicates import Predicate, to_column


class Dataset:
    """Rows of one schema that can be scanned any number of times."""

    def __init__(self, df: DataFrame, metadata: dict[str, str] | None = None):
        self.df, self.metadata = df, dict(metadata or {})

    @classmethod
    def from_batches(cls, spark: SparkSession, batches: list[pa.RecordBatch], schema: pa.Schema | None = None) -> Dataset:
        """Arrow batches in the driver's memory as a dataset; without batches a schema is needed."""
        if not batches and schema is None:
            raise InvalidArgument("no batches and no schema")
        return cls(spark.createDataFrame(pa.Table.from_batches(batches, schema)))

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def with_df(self, df: DataFrame) -> Dataset:
        return Dataset(df, self.metadata)

    def scan(self) -> DataFrame:
        return self.df

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Arrow batches; the driver holds those of one partition at a time."""

        def packed(batches):
            for batch in batches:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.record_batch({"ipc": pa.array([out.getvalue().to_pybytes()], pa.binary())})

        for row in self.df.mapInArrow(packed, "ipc binary").toLocalIterator():
            yield from pa.ipc.open_stream(bytes(row.ipc))

    def row_count(self) -> int:
        return self.df.count()

    def scan_with_projection(self, names: list[str]) -> Dataset:
        return self.with_df(rows.project_by_names(self.df, names))

    def scan_with_filter(self, test: Predicate | Column | Callable[[pa.RecordBatch], pa.RecordBatch]) -> Dataset:
        """Rows that pass a predicate or column, or what a function of Arrow batches leaves (empty batches are dropped)."""
        if isinstance(test, (Predicate, Column)):
            return self.with_df(self.df.filter(to_column(test) if isinstance(test, Predicate) else test))

        def apply(batches):
            for batch in batches:
                if (left := test(batch)).num_rows:
                    yield left

        return self.with_df(self.df.mapInArrow(apply, self.df.schema))

    def cache(self) -> Dataset:
        return self.with_df(self.df.cache())

    def repartition(self, parts: int, order: list[str] | None = None) -> Dataset:
        """``parts`` partitions; with ``order`` contiguous chunks of ceil(rows / parts) rows."""
        if parts < 1:
            raise InvalidArgument("at least one partition")
        return self.with_df(rows.repartition_in_order(self.df, order, parts) if order else self.df.repartition(parts))

    def with_schema(self, schema: T.StructType | list[str], cast: bool = False) -> Dataset:
        return self.with_df(rows.relabel(self.df, schema, cast))

    def slice(self, order: list[str], offset: int, length: int) -> Dataset:
        return self.with_df(rows.slice_rows(self.df, order, offset, length))

    def size_in_bytes(self) -> int:
        """The optimizer's estimate."""
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def __str__(self) -> str:
        shown = [f.simpleString() for f in self.schema[:5]] if len(self.schema) else []
        more = f" and {len(self.schema) - 5} more" if len(self.schema) > 5 else ""
        lines = [" | ".join(str(v) for v in r[:5]) for r in self.df.limit(10).collect()]
        return "\n".join([", ".join(shown) + more, *lines])


class DatasetBuilder:
    """Collects what a dataset is built from; build() applies schema, then partitions, then cache."""

    def __init__(self):
        self._source = self._schema = self._parts = self._order = None
        self._cache, self._metadata = False, {}

    def source(self, source: DataFrame | Callable[[], DataFrame]) -> DatasetBuilder:
        self._source = source
        return self

    def schema(self, schema: T.StructType) -> DatasetBuilder:
        self._schema = schema
        return self

    def partitions(self, parts: int, order: list[str] | None = None) -> DatasetBuilder:
        self._parts, self._order = parts, order
        return self

    def cached(self, cache: bool = True) -> DatasetBuilder:
        self._cache = cache
        return self

    def metadata(self, **values: str) -> DatasetBuilder:
        self._metadata |= values
        return self

    def build(self) -> Dataset:
        if self._source is None or self._schema is None:
            raise InvalidArgument("a dataset needs a source and a schema")
        built = Dataset(self._source() if callable(self._source) else self._source, self._metadata).with_schema(self._schema, cast=True)
        if self._parts is not None:
            built = built.repartition(self._parts, self._order)
        return built.cache() if self._cache else built
