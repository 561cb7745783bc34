"""Predicates over columns, with literals given as text, as Catalyst expressions and as tests on Parquet statistics.

A literal that its column's type can't hold, or a column that doesn't exist, makes the test false for every row, as
readers of loosely typed filters expect; ``strict=True`` raises instead. Rows are tested in SQL's three-valued logic.
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import InvalidArgument

INTEGER = re.compile(r"[+-]?[0-9]+")
FLOAT = re.compile(r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)", re.I)
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")


class Predicate:
    """Base of the tests; combine with &, | and ~, which fold constants."""

    def __and__(self, other: Predicate) -> Predicate:
        return all_of([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return any_of([self, other])

    def __invert__(self) -> Predicate:
        return negate(self)


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str
    null: bool = True


@dataclass(frozen=True)
class Member(Predicate):
    column: str
    values: tuple
    inside: bool = True


@dataclass(frozen=True)
class Text(Predicate):
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class All(Predicate):
    parts: tuple


@dataclass(frozen=True)
class Any(Predicate):
    parts: tuple


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


TRUE, FALSE = Constant(True), Constant(False)


def all_of(parts: list[Predicate]) -> Predicate:
    """The conjunction: true without parts, false if a part is, and without the parts that are always true."""
    if FALSE in parts:
        return FALSE
    left = tuple(p for p in parts if p != TRUE)
    return TRUE if not left else left[0] if len(left) == 1 else All(left)


def any_of(parts: list[Predicate]) -> Predicate:
    """The disjunction: false without parts, true if a part is, and without the parts that are always false."""
    if TRUE in parts:
        return TRUE
    left = tuple(p for p in parts if p != FALSE)
    return FALSE if not left else left[0] if len(left) == 1 else Any(left)


def negate(part: Predicate) -> Predicate:
    if isinstance(part, Constant):
        return Constant(not part.value)
    return part.part if isinstance(part, Not) else Not(part)


def parse_literal(text: str, kind: T.DataType):
    """The value that ``text`` stands for in a column of this type; None if it stands for none.

    Booleans are ``true`` or ``false``. Dates are days since 1970 or ISO dates, timestamps are nanoseconds since 1970
    or ISO timestamps.
    """
    name = kind.simpleString()
    if name == "boolean":
        return {"true": True, "false": False}.get(text)
    if name in INTEGER_BITS:
        half = 1 << INTEGER_BITS[name] - 1
        return int(text) if INTEGER.fullmatch(text) and -half <= int(text) < half else None
    if name in ("float", "double"):
        return float(text) if FLOAT.fullmatch(text) else None
    if name == "string":
        return text
    try:
        if isinstance(kind, T.DecimalType):
            return Decimal(text)
        if name == "date":
            return datetime.date(1970, 1, 1) + datetime.timedelta(days=int(text)) if INTEGER.fullmatch(text) else datetime.date.fromisoformat(text)
        if name in ("timestamp", "timestamp_ntz"):
            if INTEGER.fullmatch(text):
                moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=int(text) // 1000)
            else:
                moment = datetime.datetime.fromisoformat(text)
            return moment.replace(tzinfo=datetime.timezone.utc) if name == "timestamp" and moment.tzinfo is None else moment
    except (ValueError, OverflowError, InvalidOperation):
        pass
    return None


class Predicates:
    """Builds tests for the columns of a schema."""

    def __init__(self, schema: T.StructType | DataFrame, strict: bool = False):
        schema = schema.schema if isinstance(schema, DataFrame) else schema
        self.kinds, self.strict = {f.name: f.dataType for f in schema}, strict

    def refuse(self, why: str) -> Predicate:
        if self.strict:
            raise InvalidArgument(why)
        return FALSE

    def compare(self, op: str, column: str, value: str) -> Predicate:
        if op not in COMPARISONS:
            raise InvalidArgument(f"unknown comparison {op}")
        if column not in self.kinds:
            return self.refuse(f"no column {column}")
        parsed = parse_literal(value, self.kinds[column])
        return self.refuse(f"{value!r} is no {self.kinds[column].simpleString()}") if parsed is None else Compare(column, op, parsed)

    def eq(self, column: str, value: str) -> Predicate:
        return self.compare("eq", column, value)

    def ne(self, column: str, value: str) -> Predicate:
        return self.compare("ne", column, value)

    def lt(self, column: str, value: str) -> Predicate:
        return self.compare("lt", column, value)

    def le(self, column: str, value: str) -> Predicate:
        return self.compare("le", column, value)

    def gt(self, column: str, value: str) -> Predicate:
        return self.compare("gt", column, value)

    def ge(self, column: str, value: str) -> Predicate:
        return self.compare("ge", column, value)

    def is_null(self, column: str) -> Predicate:
        return IsNull(column)

    def is_not_null(self, column: str) -> Predicate:
        return IsNull(column, False)

    def member(self, column: str, values: list[str], inside: bool) -> Predicate:
        if column not in self.kinds:
            return self.refuse(f"no column {column}")
        parsed = [parse_literal(v, self.kinds[column]) for v in values]
        if self.strict and None in parsed:
            raise InvalidArgument(f"{values} are not all {self.kinds[column].simpleString()}")
        kept = tuple(p for p in parsed if p is not None)
        return Member(column, kept, inside) if kept else Constant(not inside)

    def is_in(self, column: str, values: list[str]) -> Predicate:
        """Values that don't parse are left out; without any left nothing matches."""
        return self.member(column, values, True)

    def not_in(self, column: str, values: list[str]) -> Predicate:
        """Without any value left everything matches, nulls too."""
        return self.member(column, values, False)

    def text(self, op: str, column: str, value: str) -> Predicate:
        if not isinstance(self.kinds.get(column), T.StringType):
            return self.refuse(f"{column} is no string column")
        return Text(column, op, value)

    def contains(self, column: str, value: str) -> Predicate:
        return self.text("contains", column, value)

    def starts_with(self, column: str, value: str) -> Predicate:
        return self.text("startswith", column, value)

    def ends_with(self, column: str, value: str) -> Predicate:
        return self.text("endswith", column, value)


def literal(value) -> Column:
    """A literal; datetimes without a zone are TIMESTAMP_NTZ."""
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def to_column(test: Predicate) -> Column:
    """The test as a Catalyst expression, which Spark pushes into the scan."""
    if isinstance(test, Constant):
        return F.lit(test.value)
    if isinstance(test, All):
        return reduce(lambda a, b: a & b, map(to_column, test.parts))
    if isinstance(test, Any):
        return reduce(lambda a, b: a | b, map(to_column, test.parts))
    if isinstance(test, Not):
        return ~to_column(test.part)
    column = F.col(f"`{test.column}`")
    if isinstance(test, IsNull):
        return column.isNull() if test.null else column.isNotNull()
    if isinstance(test, Member):
        found = column.isin(*map(literal, test.values))
        return found if test.inside else ~found
    if isinstance(test, Text):
        return getattr(column, test.op)(test.value)
    name = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}[test.op]
    return getattr(column, name)(literal(test.value))


def filter_rows(df: DataFrame, test: Predicate) -> DataFrame:
    """The rows for which the test is true."""
    return df.filter(to_column(test))


def can_push_down(test: Predicate) -> bool:
    """Whether statistics of row groups can decide the test; Spark also pushes the others to the reader."""
    if isinstance(test, (All, Any)):
        return all(map(can_push_down, test.parts))
    if isinstance(test, Not):
        return can_push_down(test.part)
    return isinstance(test, (Constant, Compare, IsNull))


@dataclass(frozen=True)
class Statistics:
    """What a row group knows of a column; None where it doesn't."""

    low: object = None
    high: object = None
    nulls: int | None = None
    rows: int | None = None


def can_skip(test: Predicate, statistics: dict[str, Statistics]) -> bool:
    """Whether no row of a row group with these statistics can pass."""
    if isinstance(test, Constant):
        return not test.value
    if isinstance(test, All):
        return any(can_skip(p, statistics) for p in test.parts)
    if isinstance(test, Any):
        return all(can_skip(p, statistics) for p in test.parts)
    if not isinstance(test, (Compare, IsNull)) or test.column not in statistics:
        return False
    known = statistics[test.column]
    if isinstance(test, IsNull):
        return known.nulls == 0 if test.null else known.nulls is not None and known.nulls == known.rows
    low, high, value = known.low, known.high, test.value
    if low is None or high is None or any(isinstance(x, float) and math.isnan(x) for x in (low, high, value)):
        return known.nulls is not None and known.nulls == known.rows
    decided = {"eq": value < low or value > high, "ne": low == high == value, "lt": low >= value, "le": low > value, "gt": high <= value, "ge": high < value}
    return decided[test.op]


def row_groups_left(path: str, test: Predicate) -> list[int]:
    """The row groups of one local Parquet file that the test can't skip, from its footer alone."""
    import pyarrow.parquet as pq

    footer = pq.read_metadata(path)
    left = []
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        statistics = {}
        for c in range(group.num_columns):
            chunk = group.column(c)
            if (s := chunk.statistics) is not None:
                low, high = (s.min, s.max) if s.has_min_max else (None, None)
                statistics[chunk.path_in_schema] = Statistics(low, high, s.null_count if s.has_null_count else None, group.num_rows)
        if not can_skip(test, statistics):
            left.append(g)
    return left
