"""String dictionaries: codes from 0 in the order in which values first appear.

A dictionary is a DataFrame (value, code) of the distinct values. Building one takes a map-side combined aggregate and
a numbering of the distinct values by ranges; encoding is an equi-join that broadcasts only dictionaries of a checked size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import rows

#: Bytes of values, with 16 for each entry, up to which a dictionary is broadcast.
BROADCAST_BYTES = 64 << 20


def build(df: DataFrame, column: str, order: str, least_count: int = 1, most_entries: int | None = None) -> DataFrame:
    """The dictionary of ``column``; ``order`` numbers the rows.

    With ``least_count`` rarer values are left out; with ``most_entries`` only the most frequent stay (ties by first row).
    """
    found = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    found = found.filter(F.col("n") >= least_count)
    if most_entries is not None:
        found = found.orderBy(F.desc("n"), "first").limit(most_entries)
    return rows.row_ids(found.select("value", "first"), ["first", "value"], "code").select("value", F.col("code").cast("int").alias("code"))


def _side(dictionary: DataFrame) -> DataFrame:
    """A dictionary as a join side, computed once: it is kept for the check of its size and the join."""
    dictionary = dictionary.persist()
    size = dictionary.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in dictionary.columns), F.lit(16)))).first()[0] or 0
    return F.broadcast(dictionary) if size <= BROADCAST_BYTES else dictionary


def encode(df: DataFrame, column: str, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """``df`` with the code of each value, null for values that the dictionary lacks."""
    return df.join(_side(dictionary.select(F.col("value").alias("_value"), F.col("code").alias(code))), F.col(column) == F.col("_value"), "left").drop("_value")


def decode(df: DataFrame, code: str, dictionary: DataFrame, column: str = "value") -> DataFrame:
    """``df`` with the value of each code; rows with an unknown code go."""
    return df.join(_side(dictionary.select(F.col("value").alias(column), F.col("code").alias("_code"))), F.col(code) == F.col("_code")).drop("_code")


def frequent_values(df: DataFrame, column: str, least_count: int = 10, most: int = 10_000) -> DataFrame:
    """(column, n): values of at least ``least_count`` rows, the ``most`` most frequent."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least_count).orderBy(F.desc("n"), column).limit(most)
