import itertools
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomwork.errors import InvalidArgument
from loomwork.operators.predicates import (
    FALSE,
    TRUE,
    All,
    Any,
    Compare,
    Not,
    Predicates,
    Statistics,
    all_of,
    any_of,
    can_push_down,
    can_skip,
    filter_rows,
    negate,
    parse_literal,
    row_groups_left,
)
from pyspark.sql import types as T

ROWS = [(0, 1, 1.0, "abc"), (1, 5, float("nan"), ""), (2, 9, 9.0, "cab"), (3, None, None, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, i int, f double, s string")


def passing(df, test):
    return [r.id for r in filter_rows(df, test).orderBy("id").collect()]


def sql_compare(op, a, b):
    if a is None:
        return None
    if isinstance(a, float):  # NaN equals itself and is above all others
        a, b = (math.isnan(a), 0 if math.isnan(a) else a), (math.isnan(b), 0 if math.isnan(b) else b)
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


@pytest.mark.parametrize("op", ["eq", "ne", "lt", "le", "gt", "ge"])
def test_comparisons(df, op):
    p = Predicates(df)
    for column, at, literals in (("i", 1, ("1", "5", "+9")), ("f", 2, ("1.0", "nan", "9")), ("s", 3, ("", "abc"))):
        for text in literals:
            value = parse_literal(text, df.schema[column].dataType)
            test = getattr(p, op)(column, text)
            assert passing(df, test) == [r[0] for r in ROWS if sql_compare(op, r[at], value)]
            assert passing(df, negate(test)) == [r[0] for r in ROWS if sql_compare(op, r[at], value) is False]


def test_three_valued_combinations(df):
    p = Predicates(df)
    tests = [p.gt("i", "4"), p.eq("s", "abc"), p.is_null("f"), p.is_not_null("s"), p.contains("s", "a")]
    truth = [
        lambda r: None if r[1] is None else r[1] > 4,
        lambda r: None if r[3] is None else r[3] == "abc",
        lambda r: r[2] is None,
        lambda r: r[3] is not None,
        lambda r: None if r[3] is None else "a" in r[3],
    ]
    both = lambda a, b: False if a is False or b is False else None if None in (a, b) else True
    either = lambda a, b: True if a is True or b is True else None if None in (a, b) else False
    for (a, f), (b, g) in itertools.combinations(zip(tests, truth, strict=True), 2):
        assert passing(df, a & b) == [r[0] for r in ROWS if both(f(r), g(r))]
        assert passing(df, a | b) == [r[0] for r in ROWS if either(f(r), g(r))]
        assert passing(df, ~(a | b)) == [r[0] for r in ROWS if either(f(r), g(r)) is False]


def test_members_and_text(df):
    p = Predicates(df)
    assert passing(df, p.is_in("i", ["1", "x", "9"])) == [0, 2]
    assert passing(df, p.not_in("i", ["1"])) == [1, 2]
    assert p.is_in("i", ["x"]) == FALSE and p.not_in("i", []) == TRUE and passing(df, p.not_in("i", ["x"])) == [0, 1, 2, 3]
    assert passing(df, p.contains("s", "b")) == [0, 2] and passing(df, p.starts_with("s", "ca")) == [2] and passing(df, p.ends_with("s", "c")) == [0]
    assert p.contains("i", "1") == FALSE and p.is_in("none", ["1"]) == FALSE and p.not_in("none", ["1"]) == FALSE


def test_literals_and_strict(df):
    p = Predicates(df)
    assert p.ne("i", "x") == FALSE and negate(p.ne("i", "x")) == TRUE and p.eq("none", "1") == FALSE
    for test in (lambda s: s.eq("i", "1.5"), lambda s: s.eq("none", "1"), lambda s: s.is_in("i", ["1", "x"])):
        with pytest.raises(InvalidArgument):
            test(Predicates(df, strict=True))
    with pytest.raises(InvalidArgument):
        p.compare("like", "s", "a")
    for text, kind, value in (("true", T.BooleanType(), True), ("yes", T.BooleanType(), None), ("128", T.ByteType(), None), ("-128", T.ByteType(), -128), (" 5", T.IntegerType(), None), ("1e3", T.DoubleType(), 1000.0), ("1.5f", T.DoubleType(), None), ("0x", T.BinaryType(), None)):
        assert parse_literal(text, kind) == value
    assert parse_literal("1", T.DateType()).isoformat() == "1970-01-02" and parse_literal("2024-02-30", T.DateType()) is None
    assert parse_literal("1500", T.TimestampNTZType()).microsecond == 1


def test_folding():
    a, b = Compare("i", "eq", 1), Compare("i", "eq", 2)
    assert all_of([]) == TRUE and any_of([]) == FALSE and all_of([a]) == a and any_of([a]) == a
    assert all_of([a, FALSE]) == FALSE and any_of([a, TRUE]) == TRUE and all_of([a, TRUE]) == a and any_of([FALSE, a]) == a
    assert all_of([a, b]) == All((a, b)) and any_of([a, b]) == Any((a, b)) and negate(negate(a)) == a and negate(TRUE) == FALSE


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "groups.parquet")
    table = pa.table({"k": pa.array([*range(40)], pa.int64()), "s": pa.array([None] * 10 + ["m"] * 10 + list("abcdefghij") + ["z"] * 10), "other": [0] * 40})
    pq.write_table(table, path, row_group_size=10)
    df = spark.read.parquet(path)
    p = Predicates(df)
    assert row_groups_left(path, p.ge("k", "25")) == [2, 3] and row_groups_left(path, p.eq("k", "12")) == [1]
    assert row_groups_left(path, p.ne("s", "z")) == [1, 2] and row_groups_left(path, p.is_null("s")) == [0] and row_groups_left(path, p.is_not_null("s")) == [1, 2, 3]
    assert row_groups_left(path, p.lt("k", "10") | p.gt("s", "y")) == [0, 3] and row_groups_left(path, p.lt("k", "5") & p.gt("s", "y")) == []
    assert row_groups_left(path, ~p.lt("k", "10")) == [0, 1, 2, 3] and row_groups_left(path, FALSE) == [] and len(row_groups_left(path, TRUE)) == 4
    assert can_push_down(p.eq("k", "1") & ~p.is_null("s")) and not can_push_down(p.contains("s", "a")) and not can_push_down(Not(p.is_in("k", ["1"])))
    plan = filter_rows(df, p.ge("k", "25") & p.starts_with("s", "z")).select("k")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,25)" in plan and "StringStartsWith(s,z)" in plan and "ReadSchema: struct<k:bigint,s:string>" in plan
    assert not can_skip(p.eq("k", "1"), {}) and can_skip(p.eq("k", "1"), {"k": Statistics(nulls=3, rows=3)})
