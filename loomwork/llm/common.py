"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Text bytes that a Python worker holds decoded at once.
SLICE_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() separates at exactly the six characters of SPACE."""
    return text.encode().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, each of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)


def columns_of(df: DataFrame, **named: str) -> DataFrame:
    """The columns an operator reads, under the operator's own names, so that others can't clash."""
    return df.select(*(F.col(f"`{column}`").alias(name) for name, column in named.items()))


def row_key(id_: Column, text: Column) -> Column:
    """What tells rows apart: 128 bits of hash of id and text."""
    return F.struct(F.xxhash64(id_, text).alias("a"), F.xxhash64(text, id_).alias("b"))


#: The type of row_key() in schemas.
ROW_KEY = "struct<a: bigint, b: bigint>"


def word_array(text: Column) -> Column:
    """The words of a text as an array, natively; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
