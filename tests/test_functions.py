import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.errors import InvalidArgument, Unsupported
from loomwork.functions import dictionary, strings, tensor, timeseries
from loomwork.functions.checksum import crc32c, crc32c_of_all, masked
from loomwork.functions.timeseries import Frequency

TEXTS = ["", "a", "héllo wörld", "😀x😀", "plain ascii"]


def test_rope(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    for i in (0, 1, 3, 50):
        left, right = strings.split_at(t, i)
        got = df.select(t, left.alias("l"), right.alias("r"), strings.insert(t, i, F.lit("++")).alias("i"), strings.char_at(t, i).alias("c"), strings.substring(t, i, 4).alias("s"), strings.delete(t, i, 4).alias("d"), strings.length(t).alias("n"), strings.byte_length(t).alias("b"), strings.is_empty(t).alias("e")).collect()
        for r in got:
            x = r.t
            assert (r.l, r.r, r.i) == (x[:i], x[i:], x[:i] + "++" + x[i:]) and r.c == (x[i] if i < len(x) else None)
            assert r.s == x[i:4] and r.d == (x if i >= 4 or i >= len(x) else x[:i] + x[4:]) and (r.n, r.b, r.e) == (len(x), len(x.encode()), not x)
    assert df.select(strings.concat(t, F.lit("!")).alias("x")).first().x == "!"


def test_lines(spark):
    df = spark.createDataFrame([(1, "﻿a\r\n\n b \nlast"), (2, None)], "id int, t string")
    assert [(r.line_number, r.text) for r in strings.lines_of(df, ["id"], "t").collect()] == [(1, "a"), (3, " b "), (4, "last")]
    lines = spark.createDataFrame([(" x ",), ("",), ("  ",)], "t string")
    assert [r.t for r in strings.clean_lines(lines, "t", trim=True).collect()] == ["x"] and strings.clean_lines(lines, "t", skip_empty=False).count() == 3
    with pytest.raises(Exception, match="more than 2 bytes"):
        strings.clean_lines(lines, "t", most_bytes=2).collect()
    assert tuple(strings.intern_stats(spark.createDataFrame([("é",), ("é",), (None,), ("ab",)], "s string"), "s").first()) == (2, 4)


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c")], "n int, v string")
    codes = dictionary.build(df, "v", "n")
    assert {r.value: r.code for r in codes.collect()} == {"b": 0, "a": 1, "c": 2}
    assert [r.code for r in dictionary.encode(df, "v", codes).orderBy("n").collect()] == [0, 1, 0, None, 2]
    assert [r.value for r in dictionary.decode(spark.createDataFrame([(2,), (9,)], "code int"), "code", codes).collect()] == ["c"]
    assert {r.value: r.code for r in dictionary.build(df, "v", "n", least_count=2).collect()} == {"b": 0}
    assert {r.value: r.code for r in dictionary.build(df, "v", "n", most_entries=2).collect()} == {"b": 0, "a": 1}
    assert dictionary.frequent_values(df, "v", 2).count() == 1


@pytest.mark.parametrize("shape", [[6], [2, 3], [2, 3, 4], [1, 1], [0, 3]])
def test_dense(spark, shape):
    values = np.arange(int(np.prod(shape)), dtype=float)
    array = values.reshape(shape)
    df = spark.createDataFrame([(values.tolist(),)], "v array<double>").select(tensor.dense(F.col("v"), shape).alias("t"))
    t = F.col("t")
    got = df.select(tensor.length(t).alias("n"), tensor.ndim(t).alias("d"), tensor.strides(t, "double").alias("s"), tensor.size_bytes(t, "double").alias("b"), tensor.is_empty(t).alias("e")).first()
    assert (got.n, got.d, got.b, got.e) == (array.size, array.ndim, array.nbytes, array.size == 0)
    if array.size:
        assert got.s == list(array.strides)
    ranges = [(min(1, n - 1) if n else 0, n) for n in shape]
    part = array[tuple(slice(a, b) for a, b in ranges)]
    cut = df.select(tensor.slice_of(t, shape, ranges).alias("x")).first().x
    assert cut.shape == list(part.shape) and cut.data == part.reshape(-1).tolist()
    flat = df.select(tensor.reshape(t, [array.size]).alias("x")).first().x
    assert flat.shape == [array.size] and flat.data == values.tolist()
    if array.size:
        at = [n - 1 for n in shape]
        assert df.select(tensor.get(t, shape, at).alias("x")).first().x == array[tuple(at)]
        assert df.select(tensor.put(t, shape, at, F.lit(-1.0)).alias("x")).first().x.data == [*values[:-1], -1.0]


def test_tensor_errors(spark):
    with pytest.raises(Exception, match="doesn't fill"):
        spark.range(1).select(tensor.dense(F.array(F.lit(1.0)), [2]).alias("t")).collect()
    for bad in (lambda: tensor.flat_index([2, 3], [2, 0]), lambda: tensor.slice_of(F.col("t"), [2], [(0, 3)]), lambda: tensor.csr(F.col("a"), F.col("a"), F.col("a"), [2])):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(Unsupported):
        tensor.to_dense(F.col("s"), [2, 2], "csc")
    assert spark.range(1).select(tensor.zeros([2, 2], "int").alias("t")).first().t.data == [0, 0, 0, 0]


def test_sparse(spark):
    one = spark.range(1)
    ints = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    reals = lambda *x: F.array(*(F.lit(float(v)) for v in x)).cast("array<double>")
    coo = tensor.coo(ints(0, 1, 1, 2, 0, 1), reals(5, 6, 7), [2, 3])
    assert one.select(tensor.to_dense(coo, [2, 3], "coo").alias("t"), tensor.nnz(coo).alias("n")).first().t.data == [0, 7, 0, 0, 0, 6]
    csr = tensor.csr(ints(0, 2, 2, 3), ints(0, 2, 1), reals(1, 2, 3), [3, 3])
    assert one.select(tensor.to_dense(csr, [3, 3], "csr").alias("t")).first().t.data == [1, 0, 2, 0, 0, 0, 0, 3, 0]
    for bad in (tensor.coo(ints(0, 3), reals(1), [2, 3]), tensor.csr(ints(0, 2), ints(0), reals(1), [1, 3]), tensor.csr(ints(0, 2, 1), ints(0), reals(1), [2, 3]), tensor.csr(ints(0, 1), ints(9), reals(1), [1, 3])):
        with pytest.raises(Exception, match="fit shape"):
            one.select(bad.alias("t")).collect()
    dense = tensor.dense(reals(0, 0.5, -0.9, 0.1), [2, 2])
    assert one.select(tensor.coo_of(dense, [2, 2], lambda v: F.abs(v) > 0.2).alias("s")).first().s.indices == [0, 1, 1, 0]


def test_checksum():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    data = [b"", b"a", b"123456789", bytes(range(256)) * 3]
    assert crc32c_of_all(data).tolist() == [crc32c(d) for d in data]
    rotated = ((0xE3069283 >> 15 | 0xE3069283 << 17) & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF
    assert masked(0xE3069283) == rotated and struct.pack("<I", masked(0))


def test_frequency():
    for text, unit, count in (("h", "hour", 1), ("5min", "minute", 5), ("15 s", "second", 15), ("10ms", "millisecond", 10), ("daily", "day", 1), ("Q", "quarter", 1), ("us", "microsecond", 1)):
        assert Frequency.parse(text) == Frequency(unit, count)
    assert Frequency.parse("y").nanoseconds == 365 * 86_400 * 10**9 and Frequency.parse("q").nanoseconds == 91 * 86_400 * 10**9 and Frequency.parse("m").nanoseconds == 30 * 86_400 * 10**9
    assert Frequency.parse("variable").nanoseconds is None and "3 months" in Frequency.parse("q").interval
    for bad in ("", "5", "fortnight", "0h"):
        with pytest.raises(InvalidArgument):
            Frequency.parse(bad)
    with pytest.raises(InvalidArgument):
        _ = Frequency.parse("ns").interval


def hours(*rows):
    start = datetime.datetime(2024, 1, 1)
    return [(k, start + datetime.timedelta(hours=h), v) for k, h, v in rows]


def test_grid_and_fills(spark):
    df = spark.createDataFrame(hours(("a", 0, 1.0), ("a", 3, 4.0), ("a", 4, None), ("b", 1, 9.0)), "k string, t timestamp_ntz, v double")
    regular = timeseries.on_grid(df, "t", Frequency.parse("h"), ["k"])
    expected = {"forward": [1, 1, 1, 4, 4], "backward": [1, 4, 4, 4, None], "linear": [1, 2, 3, 4, None], "zero": [1, 0, 0, 4, 0]}
    for method, values in expected.items():
        found = timeseries.fill(regular, "t", ["v"], method, ["k"]).orderBy("k", "t").collect()
        assert [r.v for r in found if r.k == "a"] == values and [r.v for r in found if r.k == "b"] == [9.0]
    assert sum(r.v != r.v for r in timeseries.fill(regular, "t", ["v"], "nan", ["k"]).collect()) == 3
    with pytest.raises(InvalidArgument):
        timeseries.fill(regular, "t", ["v"], "cubic")


@pytest.mark.parametrize("method", ["linear", "backward"])
@pytest.mark.parametrize("keys", [["k"], None])
def test_fill_reads_no_frame_twice(spark, method, keys):
    """Values of long gaps by a plain loop; a frame to the window's end costs the square of the series' length."""
    known = {h: float(h * h % 101) for h in (3, 4, 9, 40, 41, 130, 200, 333)}
    rows = [(k, h, known.get(h - shift)) for k, shift in (("a", 0), ("b", 50))[: 2 if keys else 1] for h in range(400)]
    rows += [("c", h, None) for h in range(5)] if keys else []
    df = spark.createDataFrame([(k, t, v, None if v is None else int(v) + 1) for k, t, v in hours(*rows)], "k string, t timestamp_ntz, v double, w int")
    filled = timeseries.fill(df, "t", ["v", "w"], method, keys)
    assert filled.columns == df.columns and "unboundedfollowing" not in filled._jdf.queryExecution().executedPlan().toString().lower()
    found = {(r.k, r.t): (r.v, r.w) for r in filled.collect()}
    assert len(found) == len(rows)
    for (k, h, v), (_, t, _) in zip(rows, hours(*rows), strict=True):
        mine = [(g, x) for j, g, x in rows if j == k and x is not None]
        right = min((x for x in mine if x[0] >= h), default=None)
        left = max((x for x in mine if x[0] <= h), default=None) if method == "linear" else right
        if left is None or right is None:
            assert found[k, t] == (None, None)
        else:
            share = (h - left[0]) / (right[0] - left[0]) if left != right else 0
            value = left[1] + (right[1] - left[1]) * share
            assert found[k, t] == pytest.approx((value, value + 1))


def test_steps(spark):
    df = spark.createDataFrame(hours(("a", 0, 1.0), ("a", 1, 4.0), ("a", 30, 5.0), ("b", 1, 9.0)), "k string, t timestamp_ntz, v double")
    assert [r.step for r in timeseries.steps(df, "t", ["k"]).orderBy("k", "t").collect()] == [None, 3_600_000_000, 29 * 3_600_000_000, None]
    found = {r.k: (r.num_rows, r.is_regular) for r in timeseries.metadata(df, "t", ["k"]).collect()}
    assert found == {"a": (3, False), "b": (1, None)}
    assert [r.v for r in timeseries.irregular(df, "t", Frequency.parse("h"), ["k"]).collect()] == [5.0]
    assert timeseries.validated(df.filter("v < 5 or k = 'b'"), "t", Frequency.parse("h"), ["k"]).count() == 3
    with pytest.raises(Exception, match="a step is"):
        timeseries.validated(df, "t", Frequency.parse("h"), ["k"]).collect()
