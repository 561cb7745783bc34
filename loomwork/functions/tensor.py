"""Dense and sparse tensors as struct columns and native expressions on them.

A dense tensor is struct<shape: array<int>, data: array<T>> in row-major order; a sparse one is struct<format, shape,
indices, indptr, values> as coordinates (COO: flat lists of coordinates, one tuple after the other) or as compressed
rows (CSR). Errors in data surface as run-time errors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.errors import InvalidArgument, Unsupported

BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1}


def _product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, b: a * b)


def _or_error(holds: Column, value: Column, why: str, kind: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.lit(why)).cast(kind))


def dense(data: Column, shape: list[int]) -> Column:
    """A tensor of this shape; its data must have as many values."""
    sizes = F.array(*map(F.lit, shape)).cast("array<int>")
    checked = F.when(F.size(data) == math.prod(shape), data).otherwise(F.raise_error(F.lit(f"data doesn't fill shape {shape}")))
    return F.struct(sizes.alias("shape"), checked.alias("data"))


def zeros(shape: list[int], kind: str = "double") -> Column:
    return dense(F.array_repeat(F.lit(0).cast(kind), math.prod(shape)), shape)


def length(tensor: Column) -> Column:
    return _product(tensor["shape"])


def ndim(tensor: Column) -> Column:
    return F.size(tensor["shape"])


def is_empty(tensor: Column) -> Column:
    return length(tensor) == 0


def size_bytes(tensor: Column, kind: str) -> Column:
    return length(tensor) * BYTES[kind]


def strides(tensor: Column, kind: str) -> Column:
    """Row-major strides in bytes."""
    shape = tensor["shape"]
    return F.transform(shape, lambda _, i: _product(F.slice(shape, i + 2, F.size(shape))) * BYTES[kind])


def reshape(tensor: Column, shape: list[int]) -> Column:
    return dense(tensor["data"], shape)


def flat_index(shape: list[int], at: list[int]) -> int:
    """The place of a cell in row-major data."""
    if len(shape) != len(at) or any(not 0 <= i < n for i, n in zip(at, shape, strict=True)):
        raise InvalidArgument(f"no cell {at} in shape {shape}")
    place = 0
    for i, n in zip(at, shape, strict=True):
        place = place * n + i
    return place


def get(tensor: Column, shape: list[int], at: list[int]) -> Column:
    return F.element_at(tensor["data"], flat_index(shape, at) + 1)


def put(tensor: Column, shape: list[int], at: list[int], value: Column) -> Column:
    """The tensor with one cell changed."""
    place, data = flat_index(shape, at), tensor["data"]
    changed = F.concat(F.slice(data, 1, place), F.array(value), F.slice(data, place + 2, math.prod(shape)))
    return F.struct(tensor["shape"].alias("shape"), changed.alias("data"))


def slice_of(tensor: Column, shape: list[int], ranges: list[tuple[int, int]]) -> Column:
    """A part: [start, end) in each dimension. Whole rows of the last dimension are copied at once."""
    if len(ranges) != len(shape) or any(not 0 <= a <= b <= n for (a, b), n in zip(ranges, shape, strict=True)):
        raise InvalidArgument(f"ranges {ranges} of shape {shape}")
    sizes = [b - a for a, b in ranges]
    out = F.array(*map(F.lit, sizes)).cast("array<int>")
    data = tensor["data"]
    if math.prod(sizes) == 0:
        return F.struct(out.alias("shape"), F.slice(data, 1, 0).alias("data"))
    rows = F.sequence(F.lit(0), F.lit(math.prod(sizes[:-1]) - 1))

    def row(r: Column) -> Column:
        start, rest = F.lit(ranges[-1][0]), r
        step = shape[-1]
        for (a, b), n in list(zip(ranges, shape, strict=True))[-2::-1]:
            start = start + (rest % (b - a) + a) * step
            rest = F.floor(rest / (b - a)).cast("int")
            step *= n
        return F.slice(data, (start + 1).cast("int"), sizes[-1])

    return F.struct(out.alias("shape"), F.flatten(F.transform(rows, row)).alias("data"))


def _sparse(layout: str, shape: list[int], indices: Column, indptr: Column, values: Column) -> Column:
    longs = "array<bigint>"
    return F.struct(
        F.lit(layout).alias("format"), F.array(*map(F.lit, shape)).cast("array<int>").alias("shape"), indices.cast(longs).alias("indices"), indptr.cast(longs).alias("indptr"), values.alias("values")
    )


def coo(indices: Column, values: Column, shape: list[int]) -> Column:
    """Coordinates, one tuple after the other, and their values."""
    n = len(shape)
    inside = F.forall(F.transform(indices, lambda x, i: (x >= 0) & (x < F.element_at(F.array(*map(F.lit, shape)), (i % n + 1).cast("int")))), lambda ok: ok)
    fits = (F.size(indices) == n * F.size(values)) & inside
    kept = _or_error(fits, indices.cast("array<bigint>"), f"coordinates don't fit shape {shape}", "array<bigint>")
    return _sparse("coo", shape, kept, F.array().cast("array<bigint>"), values)


def csr(indptr: Column, indices: Column, values: Column, shape: list[int]) -> Column:
    """Compressed rows of a matrix: row r has the entries from indptr[r] up to indptr[r + 1]."""
    if len(shape) != 2:
        raise InvalidArgument("compressed rows are a matrix")
    rising = F.forall(F.transform(indptr, lambda x, i: F.when(i == 0, x == 0).otherwise(x >= F.element_at(indptr, F.greatest(i, F.lit(1))))), lambda ok: ok)
    fits = (F.size(indptr) == shape[0] + 1) & (F.element_at(indptr, -1) == F.size(values)) & (F.size(indices) == F.size(values)) & rising
    fits = fits & F.forall(indices, lambda x: (x >= 0) & (x < shape[1]))
    kept = _or_error(fits, indptr.cast("array<bigint>"), f"rows don't fit shape {shape}", "array<bigint>")
    return _sparse("csr", shape, indices, kept, values)


def coo_of(tensor: Column, shape: list[int], keep) -> Column:
    """The cells of a dense tensor for which ``keep(value)`` holds."""
    cells = F.filter(F.transform(tensor["data"], lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: keep(c["v"]))

    def tuple_of(c: Column) -> Column:
        parts, step = [], 1
        for n in reversed(shape):
            parts.insert(0, F.floor(c["i"] / step).cast("bigint") % n)
            step *= n
        return F.array(*parts)

    return coo(F.flatten(F.transform(cells, tuple_of)), F.transform(cells, lambda c: c["v"]), shape)


def nnz(sparse: Column) -> Column:
    return F.size(sparse["values"])


def to_dense(sparse: Column, shape: list[int], layout: str, kind: str = "double") -> Column:
    """Every cell; of several entries for one cell the last counts. Only coordinates and compressed rows are defined."""
    zero, values, indices = F.lit(0).cast(kind), sparse["values"], sparse["indices"]
    if layout == "coo":
        n = len(shape)
        weights = [math.prod(shape[i + 1 :]) for i in range(n)]
        places = F.transform(
            values, lambda _, k: sum((F.element_at(indices, (k * n + i + 1).cast("int")) * w for i, w in enumerate(weights)), F.lit(0).cast("bigint"))
        )
    elif layout == "csr":
        indptr = sparse["indptr"]
        row = lambda k: F.size(F.filter(indptr, lambda p: p <= k)) - 1
        places = F.transform(indices, lambda x, k: row(k).cast("bigint") * shape[1] + x)
    else:
        raise Unsupported(f"{layout} has no dense form here")
    cells = F.arrays_zip(places.alias("place"), values.alias("value"))
    last = F.transform(
        F.sequence(F.lit(0), F.lit(max(math.prod(shape) - 1, 0))), lambda p: F.coalesce(F.try_element_at(F.filter(cells, lambda c: c["place"] == p), F.lit(-1))["value"], zero)
    )
    return dense(last if math.prod(shape) else F.array().cast(f"array<{kind}>"), shape)
