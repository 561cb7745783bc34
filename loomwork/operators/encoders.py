"""Encoders of columns for training, as plain column expressions fitted by one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.errors import InvalidArgument


def one_hot(df: DataFrame, column: str, most: int, prefix: str | None = None) -> DataFrame:
    """A 0/1 column for each of the ``most`` most frequent values of ``column`` (ties in the order of values), and one
    for all others. ``most`` bounds the new columns."""
    if most < 1:
        raise InvalidArgument("at least one value")
    value = F.col(f"`{column}`").cast("string")
    found = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(most).collect()
    values, name = [r.v for r in found], prefix or column
    hot = {f"{name}_{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(hot | {f"{name}_other": F.coalesce((~value.isin(values)).cast("int"), F.lit(0)) if values else F.lit(0)})


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, divided by its deviation (0 where that is 0)."""
    fitted = df.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("mean", F.avg), ("dev", F.stddev_pop)))).first()
    out = {}
    for i, c in enumerate(columns):
        mean, dev = fitted[f"mean_{i}"], fitted[f"dev_{i}"]
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(dev) if dev else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(out)


def tokenize(df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    """Lower-cased words of letters and digits."""
    return df.withColumn(out, F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
