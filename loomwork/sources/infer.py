"""Schema inference over text cells, by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import FormatError, InvalidArgument

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: Words that make a column boolean, and all words that parse as booleans.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")
KINDS = {"Int64": T.LongType(), "Float64": T.DoubleType(), "Boolean": T.BooleanType(), "String": T.StringType()}


def kind_of(cell: Column) -> Column:
    """The kind of a column of cells, as an aggregate: empty cells say nothing, and without others it is String."""
    value = F.when(cell != "", cell)
    whole = F.bool_and(F.when(value.isNotNull(), value.rlike(INTEGER) & value.try_cast("bigint").isNotNull()))
    return (
        F.when(F.count(value) == 0, "String")
        .when(whole, "Int64")
        .when(F.bool_and(value.rlike(FLOAT)), "Float64")
        .when(F.bool_and(F.lower(value).isin(*BOOLEAN_WORDS)), "Boolean")
        .otherwise("String")
    )


def infer_schema(df: DataFrame, rows: int = 1000) -> T.StructType:
    """The schema of a DataFrame of text cells, from its first ``rows`` rows; all fields are nullable."""
    if not df.columns:
        raise InvalidArgument("no columns")
    found = df.limit(rows).agg(F.count("*"), *(kind_of(F.col(f"`{c}`")) for c in df.columns)).first()
    if found[0] == 0:
        raise FormatError("nothing to infer a schema from")
    return T.StructType([T.StructField(c, KINDS[k], True) for c, k in zip(df.columns, found[1:], strict=True)])


def infer_records(records: list[list[str]], names: list[str] | None = None) -> T.StructType:
    """The same for records in the driver: all of one length, named ``column_<i>`` without names."""
    import re

    if not records:
        raise FormatError("nothing to infer a schema from")
    width = len(records[0])
    if any(len(r) != width for r in records) or (names is not None and len(names) != width):
        raise FormatError("records of different lengths")

    def kind(cells: list[str]) -> str:
        cells = [c for c in cells if c]
        if not cells:
            return "String"
        if all(re.match(INTEGER, c) and -(1 << 63) <= int(c) < 1 << 63 for c in cells):
            return "Int64"
        if all(re.match(FLOAT, c) for c in cells):
            return "Float64"
        return "Boolean" if all(c.lower() in BOOLEAN_WORDS for c in cells) else "String"

    names = names or [f"column_{i}" for i in range(width)]
    return T.StructType([T.StructField(n, KINDS[kind([r[i] for r in records])], True) for i, n in enumerate(names)])


def typed(cell: Column, kind: T.DataType, name: str) -> Column:
    """A text cell as a value: an empty cell is null but in string columns; one that doesn't parse fails at run time."""
    if isinstance(kind, T.StringType):
        return F.coalesce(cell, F.lit("")).alias(name)
    value = F.when(cell != "", cell)
    shown = kind.simpleString()
    if shown in ("tinyint", "smallint", "int", "bigint"):
        parsed = F.when(value.rlike(INTEGER), value.try_cast(shown))
    elif shown in ("float", "double"):
        parsed = F.when(value.rlike(FLOAT), value.try_cast(shown))
    elif shown == "boolean":
        parsed = F.when(F.lower(value).isin(*TRUE_WORDS), True).when(F.lower(value).isin(*FALSE_WORDS), False)
    else:
        parsed = value.try_cast(shown)
    wrong = F.raise_error(F.concat(F.lit(f"column {name} ({shown}): "), value)).cast(shown)
    return F.when(value.isNull() | parsed.isNotNull(), parsed).otherwise(wrong).alias(name)
