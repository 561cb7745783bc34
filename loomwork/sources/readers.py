"""Readers: each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import FormatError, InvalidArgument, Unsupported
from loomwork.functions import strings
from loomwork.functions.timeseries import Frequency, on_grid, fill, validated
from loomwork.operators.predicates import Predicate, to_column
from loomwork.sources import detect
from loomwork.sources.infer import infer_schema, typed

INFERENCE_ROWS = 1000


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | None = None,
    header: bool = True,
    delimiter: str = ",",
    quote: str = '"',
    escape: str | None = None,
    comment: str | None = None,
    trim: bool = False,
    columns: list[str] | None = None,
    inference_rows: int = INFERENCE_ROWS,
) -> DataFrame:
    """Typed rows of CSV files. Without a schema the types come from the first rows, which are returned like all others.

    A record with more or fewer cells, or a cell that doesn't parse, fails at run time. Quotes are doubled inside quotes.
    """
    options = {"header": header, "sep": delimiter, "quote": quote, "escape": escape or quote, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim}
    if comment:
        options["comment"] = comment
    reader = spark.read.options(**options)
    paths = [paths] if isinstance(paths, str) else paths
    if schema is None:
        cells = reader.csv(paths)
        if not header:
            cells = cells.toDF(*(f"column_{i}" for i in range(len(cells.columns))))
        schema = infer_schema(cells, inference_rows)
    text = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(paths)
    out = text.select(*(typed(F.col(f"`{f.name}`"), f.dataType, f.name) for f in schema))
    return out.select(*columns) if columns else out


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, predicate: Predicate | None = None) -> DataFrame:
    """Rows of Parquet files; columns and predicate reach the scan."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if predicate is not None:
        df = df.filter(to_column(predicate))
    return df.select(*columns) if columns else df


def parquet_metadata(path: str) -> dict[str, int]:
    """Rows, row groups and columns of one local file, from its footer."""
    import pyarrow.parquet as pq

    footer = pq.read_metadata(path)
    return {"num_rows": footer.num_rows, "num_row_groups": footer.num_row_groups, "num_columns": footer.num_columns}


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None, multiline: bool | None = None) -> DataFrame:
    """JSON documents: one per line for .jsonl and .ndjson, else one per file."""
    paths = [paths] if isinstance(paths, str) else paths
    if multiline is None:
        multiline = detect.format_of_path(paths[0]) in ("json", "json.gz")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(paths, multiLine=multiline, mode="FAILFAST")


def read_text(
    spark: SparkSession,
    paths: str | list[str],
    trim: bool = False,
    skip_empty: bool = True,
    strip_bom: bool = True,
    most_bytes: int | None = 1 << 20,
    with_path: bool = False,
) -> DataFrame:
    """(line_number, text) of text files: numbers from 1 in each file, skipped lines counted.

    Files are split over tasks. Lines are numbered inside each split, and the splits' counts, one row a split, give each
    split's first number.
    """
    lines = spark.read.text([paths] if isinstance(paths, str) else paths).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    splits = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = splits.select("_path", "_block", (before - F.col("_low") + 1).alias("_first"))
    # One row for each split of the scan.
    numbered = lines.join(F.broadcast(firsts), ["_path", "_block"]).withColumn("line_number", F.col("_id") + F.col("_first"))
    if strip_bom:
        numbered = numbered.withColumn("text", F.when(F.col("line_number") == 1, strings.strip_bom(F.col("text"))).otherwise(F.col("text")))
    kept = strings.clean_lines(numbered, "text", trim, skip_empty, most_bytes)
    return kept.select("line_number", "text", *([F.col("_path").alias("path")] if with_path else []))


def read_binary(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content): whole files."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)


def read_arrow(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of Arrow IPC files or streams, one task a file; the schema comes from the first file."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def opened(content: bytes):
        buffer = pa.BufferReader(content)
        try:
            return pa.ipc.open_file(buffer)
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.BufferReader(content))

    files = read_binary(spark, paths).select("path", "content")
    first = files.orderBy("path").limit(1).first()
    if first is None:
        raise FormatError("no Arrow file")
    schema = plain_schema(opened(first.content).schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                reader = opened(content.as_buffer().to_pybytes())
                found = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader
                for part in found:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema, strict=True)], schema=schema)

    out = files.select("content").mapInArrow(rows, from_arrow_schema(schema, prefer_timestamp_ntz=True))
    return out.select(*columns) if columns else out


def plain_schema(schema: pa.Schema) -> pa.Schema:
    """An Arrow schema in types that Spark holds: dictionaries as values, unsigned and half types widened."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}

    def plain(kind: pa.DataType) -> pa.DataType:
        if pa.types.is_dictionary(kind):
            return plain(kind.value_type)
        if pa.types.is_fixed_size_binary(kind):
            return pa.binary()
        if pa.types.is_timestamp(kind):
            return pa.timestamp("us", kind.tz)
        if pa.types.is_date64(kind):
            return pa.timestamp("us")
        if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
            return pa.list_(plain(kind.value_type))
        if pa.types.is_large_string(kind):
            return pa.string()
        if pa.types.is_large_binary(kind):
            return pa.binary()
        return wider.get(kind, kind)

    return pa.schema([pa.field(f.name, plain(f.type), f.nullable) for f in schema])


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database whose JDBC driver is on the class path; ``partition``: column, lower and upper bound, parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def read_avro(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Avro files, where the Avro module is on the class path."""
    try:
        return spark.read.format("avro").load(paths)
    except Exception as error:
        if "avro" in str(error).lower():
            raise Unsupported("Avro needs Spark's avro module on the class path") from error
        raise


def read_timeseries(
    spark: SparkSession,
    paths: str | list[str],
    kind: str = "parquet",
    time_column: str = "timestamp",
    value_columns: list[str] | None = None,
    keys: list[str] | None = None,
    time_unit: str | None = None,
    frequency: str | None = None,
    validate_frequency: bool = False,
    fill_missing: bool = False,
    fill_method: str = "forward",
) -> DataFrame:
    """(keys..., time, values as doubles) of CSV, Parquet, JSON or Arrow files.

    ``time_unit`` says what integers count since 1970. Values are all other columns if none are named.
    """
    readers: dict[str, Callable] = {"csv": read_csv, "parquet": read_parquet, "json": read_json, "jsonl": read_json, "arrow": read_arrow}
    if kind not in readers:
        raise Unsupported(f"time series as {kind}")
    df, keys = readers[kind](spark, paths), keys or []
    if time_column not in df.columns:
        raise InvalidArgument(f"no column {time_column}")
    values = value_columns or [c for c in df.columns if c != time_column and c not in keys]
    time, stored = F.col(time_column), df.schema[time_column].dataType
    if isinstance(stored, (T.LongType, T.IntegerType)):
        micros = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": None}[time_unit or "ns"]
        time = F.timestamp_micros(time * micros if micros else F.floor(time / 1000))
    out = df.select(*keys, time.cast("timestamp_ntz").alias(time_column), *(F.col(v).cast("double").alias(v) for v in values))
    if frequency is None:
        if fill_missing or validate_frequency:
            raise InvalidArgument("a frequency is needed")
        return out
    step = Frequency.parse(frequency)
    if fill_missing:
        return fill(on_grid(out, time_column, step, keys), time_column, values, fill_method, keys)
    return validated(out, time_column, step, keys) if validate_frequency else out


def read_files(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Files of one format, which their names tell."""
    from loomwork.sources.images import read_images
    from loomwork.sources.tfrecord import read_tfrecords

    paths = [paths] if isinstance(paths, str) else paths
    formats = {detect.format_of_path(p) for p in paths}
    if len(formats) != 1:
        raise InvalidArgument(f"files of different formats: {sorted(map(str, formats))}")
    kind = formats.pop()
    readers = {"csv": read_csv, "csv.gz": read_csv, "parquet": read_parquet, "json": read_json, "json.gz": read_json, "jsonl": read_json, "arrow": read_arrow, "avro": read_avro, "tfrecord": read_tfrecords, "image": read_images}
    if kind not in readers:
        raise Unsupported(f"no reader for {kind}")
    return readers[kind](spark, paths, **options)
