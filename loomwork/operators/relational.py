"""Extensions beyond the reader's contract: joins, tops and sessions that Spark lacks a single call for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Estimated bytes up to which a join side is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a side whose estimated size is under the bound; otherwise leave the choice to the optimizer."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of its keys that isn't later.

    Both sides go through one shuffle by key as a tagged union, and a window carries the last right row forward.
    """
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).filter("_side = 1")
    return carried.select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the ranges [start, end) that hold them: ranges are cut into buckets of ``width``, joined by equality."""
    bucket = F.floor(F.col(point) / width)
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_bucket", bucket).join(cut, "_bucket").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, order: list[str] | None = None) -> DataFrame:
    """Numbers each key's sessions from 1; one ends where the next row is later than ``gap`` (an interval as text)."""
    by = W.partitionBy(*keys).orderBy(time, *(order or []))
    new = F.coalesce((F.col(time) > F.lag(time).over(by) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
