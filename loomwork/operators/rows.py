"""Projections, slices and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import InvalidArgument, SchemaMismatch


def project(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by position, in the order given; a position may repeat."""
    if any(not 0 <= p < len(df.columns) for p in positions):
        raise InvalidArgument(f"positions {positions} of {len(df.columns)} columns")
    return df.select(*(F.col(f"`{df.columns[p]}`") for p in positions))


def project_by_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by name; an unknown name is an error at once."""
    if unknown := [n for n in names if n not in df.columns]:
        raise InvalidArgument(f"no columns {unknown}")
    return df.select(*(F.col(f"`{n}`") for n in names))


def relabel(df: DataFrame, schema: T.StructType | list[str], cast: bool = False) -> DataFrame:
    """New names for all columns in order; with ``cast`` also the types of a schema."""
    names = schema.names if isinstance(schema, T.StructType) else list(schema)
    if len(names) != len(df.columns):
        raise SchemaMismatch(f"{len(names)} names for {len(df.columns)} columns")
    renamed = df.toDF(*names)
    return renamed.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)) if cast else renamed


#: Rows up to which a slice's end is found by a top-k sort, which brings so many rows to one task.
TOP_ROWS = 100_000


def slice_rows(df: DataFrame, order: list[str], offset: int, length: int) -> DataFrame:
    """``length`` rows from ``offset`` on in the order of ``order``: a bounded top-k sort, or deeper down by row numbers.

    Row numbers need an order without ties.
    """
    if offset < 0 or length < 0:
        raise InvalidArgument("a slice starts at 0 or later and has no negative length")
    if offset + length > TOP_ROWS:
        numbered = row_ids(df, order, "_slice_row")
        return numbered.filter((F.col("_slice_row") >= offset) & (F.col("_slice_row") < offset + length)).drop("_slice_row")
    return df.orderBy(*order).limit(offset + length).offset(offset)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return slice_rows(df, order, 0, n)


#: Keys sampled for each part when rows are numbered.
SAMPLED_KEYS = 40


def key_bounds(df: DataFrame, order: list[str], parts: int) -> list:
    """Keys that cut the rows into about equal parts: every so many of a sample that a hash chooses, so reruns agree."""
    keys = df.select(F.struct(*order).alias("key"))
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(parts * SAMPLED_KEYS).orderBy("key").collect()
    at = [len(sample) * i // parts for i in range(1, parts)]
    return list(dict.fromkeys(sample[i].key for i in at)) if sample else []


def row_ids(df: DataFrame, order: list[str], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the order of ``order`` (which should leave no ties), in parallel.

    Rows are numbered inside ranges of keys, and the ranges' sizes give each range's first number. One window over all
    rows would put them in one task.
    """
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key, bounds = F.struct(*order), key_bounds(df, order, parts)
    kind = df.select(key.alias("key")).schema["key"].dataType
    literals = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind, strict=True))) for b in bounds]
    # No lambda here: Catalyst would carry one over the join on the range as an inferred filter that it can't bind.
    part = F.greatest(F.lit(0), *(F.when(b <= key, i + 1).otherwise(0) for i, b in enumerate(literals))) if literals else F.lit(0)
    placed = df.withColumn("_part", part)
    numbered = placed.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each of at most ``parts`` ranges.
    firsts = F.broadcast(sizes.select("_part", before.alias("_first")))
    return numbered.join(firsts, "_part").withColumn(name, (F.col("_first") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_first")


def contiguous_parts(df: DataFrame, order: list[str], parts: int, name: str = "part") -> DataFrame:
    """The number of the contiguous chunk of ceil(rows / parts) rows that each row is in."""
    if parts < 1:
        raise InvalidArgument("at least one part")
    rows = df.count()
    size = max(1, -(-rows // parts))
    return row_ids(df, order, "_row").withColumn(name, F.floor(F.col("_row") / size).cast("bigint")).drop("_row")


def repartition_in_order(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Partitions that are contiguous chunks in order, each sorted."""
    chunked = contiguous_parts(df, order, parts, "_chunk")
    return chunked.repartitionByRange(parts, "_chunk").sortWithinPartitions("_chunk", *order).drop("_chunk")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: for each column the number of nulls and whether there are any."""
    out = []
    for c in columns or df.columns:
        missing = F.count_if(F.col(f"`{c}`").isNull())
        out += [missing.alias(f"{c}_null_count"), (missing > 0).alias(f"{c}_has_nulls")]
    return df.agg(*out)
