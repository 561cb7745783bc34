"""Text edits as column expressions. Positions are code points from 0; byte_length() counts bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def concat(left: Column, right: Column) -> Column:
    return F.concat(left, right)


def length(text: Column) -> Column:
    return F.char_length(text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def is_empty(text: Column) -> Column:
    return F.octet_length(text) == 0


def substring(text: Column, start: int | Column, end: int | Column) -> Column:
    """From ``start`` up to ``end``, which may lie behind the text; empty if start >= end."""
    start, end = _int(start), _int(end)
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def split_at(text: Column, at: int | Column) -> tuple[Column, Column]:
    """The parts before and from ``at`` on; behind the text's end the second is empty."""
    return substring(text, 0, at), F.substring(text, _int(at) + 1, F.char_length(text))


def insert(text: Column, at: int | Column, other: Column) -> Column:
    left, right = split_at(text, at)
    return F.concat(left, other, right)


def delete(text: Column, start: int | Column, end: int | Column) -> Column:
    """Without [start, end); unchanged if start >= end or start lies behind the text."""
    start, end = _int(start), _int(end)
    cut = F.concat(substring(text, 0, start), F.substring(text, end + 1, F.char_length(text)))
    return F.when((start >= end) | (start >= F.char_length(text)), text).otherwise(cut)


def char_at(text: Column, at: int | Column) -> Column:
    """One character, null outside the text."""
    return F.nullif(F.substring(text, _int(at) + 1, F.lit(1)), F.lit(""))


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\uFEFF", "")


def clean_lines(df: DataFrame, column: str, trim: bool = False, skip_empty: bool = True, most_bytes: int | None = 1 << 20) -> DataFrame:
    """Lines trimmed, without empty ones, failing at run time on one of more than ``most_bytes`` bytes."""
    text = F.trim(F.col(column)) if trim else F.col(column)
    if most_bytes is not None:
        too_long = F.raise_error(F.concat(F.lit(f"a line has more than {most_bytes} bytes: "), F.octet_length(text).cast("string")))
        text = F.when(F.octet_length(text) > most_bytes, too_long.cast("string")).otherwise(text)
    out = df.withColumn(column, text)
    return out.filter(F.col(column) != "") if skip_empty else out


def intern_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: the number of distinct strings n and their bytes."""
    return df.select(F.col(column).alias("s")).distinct().filter("s is not null").agg(F.count("s").alias("n"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).cast("bigint").alias("bytes"))


def lines_of(df: DataFrame, keep: list[str], column: str, skip_empty: bool = True) -> DataFrame:
    """(keep..., line_number, text): the lines of a text column, numbered from 1 with the skipped ones counted."""
    split = df.select(*keep, F.posexplode(F.split(strip_bom(F.col(column)), r"\r?\n")).alias("at", "text"))
    out = split.select(*keep, (F.col("at") + 1).cast("bigint").alias("line_number"), "text")
    return out.filter(F.col("text") != "") if skip_empty else out
