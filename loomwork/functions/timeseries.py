"""Time series: frequencies, regular grids, gap filling and checks of the steps between rows.

A table may hold many series, told apart by ``keys``; windows are partitioned by them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.errors import InvalidArgument

SECOND = 1_000_000_000
DAY = 86_400 * SECOND
#: Lengths of the units in nanoseconds, with the names they go by.
UNITS = {
    "year": (365 * DAY, "y yr year years yearly annual"),
    "quarter": (91 * DAY, "q quarter quarters quarterly"),
    "month": (30 * DAY, "m mo month months monthly"),
    "week": (7 * DAY, "w week weeks weekly"),
    "day": (DAY, "d day days daily"),
    "hour": (3_600 * SECOND, "h hr hour hours hourly"),
    "minute": (60 * SECOND, "min t minute minutes minutely"),
    "second": (SECOND, "s sec second seconds secondly"),
    "millisecond": (1_000_000, "ms milli millisecond milliseconds"),
    "microsecond": (1_000, "us micro microsecond microseconds"),
    "nanosecond": (1, "ns nano nanosecond nanoseconds"),
}
NAMES = {name: unit for unit, (_, names) in UNITS.items() for name in names.split()}
FILLS = ("forward", "backward", "linear", "zero", "nan")


@dataclass(frozen=True)
class Frequency:
    """So many of a unit; without a unit the steps vary."""

    unit: str | None
    count: int = 1

    @classmethod
    def parse(cls, text: str) -> Frequency:
        """``h``, ``hourly``, ``5min``, ``variable`` and the like."""
        text = text.strip().lower()
        if text in ("variable", "irregular"):
            return cls(None)
        found = re.fullmatch(r"([0-9]*)\s*([a-z]+)", text)
        if not found or found[2] not in NAMES or found[1].strip("0") == "" != found[1]:
            raise InvalidArgument(f"no frequency: {text!r}")
        return cls(NAMES[found[2]], int(found[1] or 1))

    @property
    def nanoseconds(self) -> int | None:
        """The length of a step; years, quarters and months count 365, 91 and 30 days."""
        return None if self.unit is None else UNITS[self.unit][0] * self.count

    @property
    def interval(self) -> str:
        """The step as a SQL interval, by the calendar from months up."""
        if self.unit is None or self.nanoseconds < 1_000:
            raise InvalidArgument("only steps of a microsecond or more make a grid")
        if self.unit in ("year", "quarter", "month"):
            return f"interval {self.count * {'year': 12, 'quarter': 3, 'month': 1}[self.unit]} months"
        return f"interval {self.nanoseconds // 1_000} microseconds"


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def grid(df: DataFrame, time: str, frequency: Frequency, keys: list[str] | None = None, start=None, end=None) -> DataFrame:
    """(keys..., time): each step from the first to the last time of each series, or from ``start`` to ``end``."""
    keys = keys or []
    ends = df.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    first = F.col("_first") if start is None else start
    last = F.col("_last") if end is None else end
    return ends.filter(F.col("_first").isNotNull()).select(*keys, F.explode(F.sequence(first, last, F.expr(frequency.interval))).alias(time))


def on_grid(df: DataFrame, time: str, frequency: Frequency, keys: list[str] | None = None, start=None, end=None) -> DataFrame:
    """The series with a row for each step; values are null where there was none."""
    keys = keys or []
    steps = grid(df, time, frequency, keys, start, end)
    return steps.join(df, [*keys, time], "left")


def _next(column: str, by) -> Column:
    """The nearest value after the row that isn't null. A frame to the end of the window is read anew for each row; this isn't."""
    return F.expr(f"lead({column}) IGNORE NULLS").over(by)


def fill(df: DataFrame, time: str, columns: list[str], method: str, keys: list[str] | None = None) -> DataFrame:
    """Nulls filled by the value before, the value after, the line between both, zero or NaN.

    Forward leaves leading nulls, backward trailing ones, linear both. One series without keys is windowed by calendar
    day; what reaches over a day comes from one row of each day.
    """
    if method not in FILLS:
        raise InvalidArgument(f"unknown fill {method}")
    out, seconds = {}, micros(F.col(time)) / 1e6
    if not keys and method in ("forward", "backward", "linear"):
        return _filled_by_day(df, time, columns, method)
    by = W.partitionBy(*(keys or [])).orderBy(time)
    before, marked = by.rowsBetween(W.unboundedPreceding, 0), {}
    for i, c in enumerate(columns):
        value, known, at = F.col(c), f"_known_{i}", f"_at_{i}"
        if method == "forward":
            out[c] = F.last(value, ignorenulls=True).over(before)
        elif method == "backward":
            marked[known] = value
            out[c] = F.coalesce(F.col(known), _next(known, by))
        elif method in ("zero", "nan"):
            out[c] = F.coalesce(value, F.lit(0 if method == "zero" else float("nan")).cast(df.schema[c].dataType if method == "zero" else "double"))
        else:
            marked |= {known: value, at: F.when(value.isNotNull(), seconds)}
            left, low = (F.last(x, ignorenulls=True).over(before) for x in (known, at))
            right, high = (_next(x, by) for x in (known, at))
            left, right = left.cast("double"), right.cast("double")
            out[c] = F.when(F.col(known).isNotNull(), F.col(known).cast("double")).otherwise(left + (right - left) * (seconds - low) / (high - low))
    return df.withColumns(marked).withColumns(out).drop(*marked) if marked else df.withColumns(out)


def _filled_by_day(df: DataFrame, time: str, columns: list[str], method: str) -> DataFrame:
    day = F.date_trunc("day", F.col(time))
    cut = df.withColumn("_day", day)
    known = {c: f"_known_{i}" for i, c in enumerate(columns)}
    cut = cut.withColumns({k: F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col(time).alias("t"), F.col(f"`{c}`").alias("v"))) for c, k in known.items()})
    ends = cut.groupBy("_day").agg(*(F.max(k).alias(f"_last_{i}") for i, k in enumerate(known.values())), *(F.min(k).alias(f"_first_{i}") for i, k in enumerate(known.values())))
    # One row for each day.
    days = W.orderBy("_day")
    carried = [F.last(f"_last_{i}", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, -1)).alias(f"_before_{i}") for i in range(len(columns))]
    carried += [_next(f"_first_{i}", days).alias(f"_after_{i}") for i in range(len(columns))]
    joined = cut.join(ends.select("_day", *carried).withColumnRenamed("_day", "_of"), F.col("_day").eqNullSafe(F.col("_of")), "left")
    inside = W.partitionBy("_day").orderBy(time)
    out = {}
    for i, (c, here) in enumerate(known.items()):
        left = F.coalesce(F.last(here, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col(f"_before_{i}"))
        right = F.coalesce(F.col(here), _next(here, inside), F.col(f"_after_{i}"))
        if method == "forward":
            out[c] = left["v"]
        elif method == "backward":
            out[c] = right["v"]
        else:
            at, low, high = (micros(t) / 1e6 for t in (F.col(time), left["t"], right["t"]))
            from_, to = left["v"].cast("double"), right["v"].cast("double")
            out[c] = F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").cast("double")).otherwise(from_ + (to - from_) * (at - low) / (high - low))
    return joined.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns))


def steps(df: DataFrame, time: str, keys: list[str] | None = None, order: list[str] | None = None, bucket: str = "day") -> DataFrame:
    """``df`` with ``step``: microseconds since the series' row before.

    Rows are windowed by calendar bucket, so one long series is spread over tasks; a bucket's first row takes its step
    from the last row of the bucket before, of which there is one row per bucket.
    """
    keys, order = keys or [], [time, *(order or [])]
    cut = df.withColumn("_bucket", F.date_trunc(bucket, F.col(time)))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    ends = cut.groupBy(*keys, "_bucket").agg(F.max(time).alias("_end"))
    earlier = ends.select(*keys, "_bucket", F.lag("_end").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_earlier"))
    marked = cut.withColumn("_before", F.lag(time).over(inside))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_bucket"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = marked.alias("a").join(earlier.alias("b"), on, "left")
    previous = F.coalesce(F.col("a._before"), F.col("b._earlier"))
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (micros(F.col(f"a.{time}")) - micros(previous)).alias("step"))


def metadata(df: DataFrame, time: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """For each series: num_rows, start_ts, end_ts, step (the most frequent, in microseconds) and is_regular."""
    keys = keys or []
    found = steps(df, time, keys, order)
    return found.groupBy(*keys).agg(
        F.count("*").alias("num_rows"), F.min(time).alias("start_ts"), F.max(time).alias("end_ts"), F.mode("step").alias("step"), (F.min("step") == F.max("step")).alias("is_regular")
    )


def irregular(df: DataFrame, time: str, frequency: Frequency, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows whose step isn't the frequency's, with the step."""
    return steps(df, time, keys, order).filter(F.col("step") != frequency.nanoseconds // 1_000)


def validated(df: DataFrame, time: str, frequency: Frequency, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``df``, failing at run time if a step isn't the frequency's."""
    wrong = F.raise_error(F.concat(F.lit("a step is "), F.col("step").cast("string"), F.lit(f" microseconds, not {frequency.interval}")))
    found = steps(df, time, keys, order)
    return found.filter(F.when(F.col("step").isNull() | (F.col("step") == frequency.nanoseconds // 1_000), F.lit(True)).otherwise(wrong.cast("boolean"))).select(*df.columns)
