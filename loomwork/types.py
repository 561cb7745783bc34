"""The data model: kinds of values, the Spark types that hold them, and schemas.

A kind without a Spark type of its own is stored in the nearest wider one, and the field's metadata says what it is:
unsigned integers widen, fixed sizes and tensor shapes are checked by :func:`checked`.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import InvalidArgument, SchemaMismatch

SIMPLE = {
    "boolean": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "date32": T.DateType(),
    "date64": T.TimestampNTZType(),
    "null": T.NullType(),
}
NUMERIC = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64")
UNSIGNED_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
SPARSE_FORMATS = ("coo", "csr", "csc", "bsr")


@dataclass(frozen=True)
class Kind:
    """One kind of value. ``children`` are (name, kind) pairs; ``args`` are what else the kind needs."""

    name: str
    args: tuple = ()
    children: tuple[tuple[str, Kind], ...] = ()

    @property
    def is_numeric(self) -> bool:
        return self.name in NUMERIC or self.name == "decimal"

    def child(self, at: int = 0) -> Kind:
        return self.children[at][1]

    def spark(self) -> T.DataType:
        """The Spark type that stores this kind."""
        name = self.name
        if name in SIMPLE:
            return SIMPLE[name]
        if name == "fixed_binary":
            return T.BinaryType()
        if name == "timestamp":
            return T.TimestampNTZType() if self.args[1] is None else T.TimestampType()
        if name == "time":
            return T.TimeType(6)
        if name == "decimal":
            return T.DecimalType(*self.args)
        if name in ("list", "fixed_list"):
            return T.ArrayType(self.child().spark())
        if name == "struct":
            return T.StructType([T.StructField(n, k.spark()) for n, k in self.children])
        if name == "map":
            return T.MapType(self.child(0).spark(), self.child(1).spark())
        if name == "tensor":
            return T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(self.child().spark()))])
        if name == "sparse_tensor":
            longs = T.ArrayType(T.LongType())
            return T.StructType(
                [
                    T.StructField("format", T.StringType()),
                    T.StructField("shape", T.ArrayType(T.IntegerType())),
                    T.StructField("indices", longs),
                    T.StructField("indptr", longs),
                    T.StructField("values", T.ArrayType(self.child().spark())),
                ]
            )
        if name == "dictionary":
            return self.child(1).spark()
        if name == "extension":
            return self.child().spark()
        if name == "union":
            return T.StructType([T.StructField("tag", T.IntegerType()), *(T.StructField(f"f{i}", k.spark()) for i, (_, k) in enumerate(self.children))])
        raise InvalidArgument(f"unknown kind {name}")

    def text(self) -> str:
        """How the kind is written, such as ``list<int32>``."""
        inside = [str(a) for a in self.args] + [k.text() if n in ("", "item", "key", "value") else f"{n}: {k.text()}" for n, k in self.children]
        return f"{self.name}<{', '.join(inside)}>" if inside else self.name

    def accepts(self, other: Kind) -> bool:
        """Whether columns of the two kinds go together: equal, both numeric, alike in structure, or one of them null."""
        if self == other or "null" in (self.name, other.name):
            return True
        if self.name in NUMERIC and other.name in NUMERIC:
            return True
        if self.name != other.name or self.name not in ("list", "fixed_list", "struct", "map", "tensor", "dictionary"):
            return False
        return len(self.children) == len(other.children) and all(a.accepts(b) for (_, a), (_, b) in zip(self.children, other.children, strict=True))


def simple(name: str) -> Kind:
    if name not in SIMPLE:
        raise InvalidArgument(f"unknown kind {name}")
    return Kind(name)


def fixed_binary(size: int) -> Kind:
    return Kind("fixed_binary", (size,))


def timestamp(unit: str = "us", zone: str | None = None) -> Kind:
    if unit not in ("s", "ms", "us", "ns"):
        raise InvalidArgument(f"unknown unit {unit}")
    return Kind("timestamp", (unit, zone))


def time(unit: str = "us") -> Kind:
    return Kind("time", (unit,))


def decimal(precision: int, scale: int) -> Kind:
    if not 0 < precision <= 38:
        raise InvalidArgument("a decimal has 1 to 38 digits")
    return Kind("decimal", (precision, scale))


def list_of(item: Kind, size: int | None = None) -> Kind:
    return Kind("list", (), (("item", item),)) if size is None else Kind("fixed_list", (size,), (("item", item),))


def struct_of(**children: Kind) -> Kind:
    return Kind("struct", (), tuple(children.items()))


def map_of(key: Kind, value: Kind) -> Kind:
    return Kind("map", (), (("key", key), ("value", value)))


def tensor_of(item: Kind, shape: tuple[int, ...]) -> Kind:
    """A tensor; a dimension of 0 can have any length."""
    return Kind("tensor", (tuple(shape),), (("item", item),))


def sparse_tensor_of(item: Kind, shape: tuple[int, ...], layout: str = "coo") -> Kind:
    if layout not in SPARSE_FORMATS:
        raise InvalidArgument(f"unknown layout {layout}")
    return Kind("sparse_tensor", (tuple(shape), layout), (("item", item),))


def dictionary_of(key: Kind, value: Kind) -> Kind:
    return Kind("dictionary", (), (("key", key), ("value", value)))


def extension_of(name: str, storage: Kind, params: bytes = b"") -> Kind:
    return Kind("extension", (name, base64.b64encode(params).decode()), (("item", storage),))


def union_of(*kinds: Kind) -> Kind:
    return Kind("union", (), tuple((f"f{i}", k) for i, k in enumerate(kinds)))


@dataclass(frozen=True)
class Field:
    """A named column."""

    name: str
    kind: Kind
    nullable: bool = True
    metadata: dict = default(default_factory=dict, compare=False, hash=False)

    def spark(self) -> T.StructField:
        return T.StructField(self.name, self.kind.spark(), self.nullable, dict(self.metadata) | {"kind": self.kind.text()})

    def accepts(self, other: Field) -> bool:
        """A nullable field takes all fields of an accepted kind; one that isn't takes only its like."""
        return self.kind.accepts(other.kind) and (self.nullable or not other.nullable)


class Schema:
    """Ordered fields with distinct names, and metadata of the whole."""

    def __init__(self, fields: list[Field], metadata: dict[str, str] | None = None):
        names = [f.name for f in fields]
        if len(set(names)) < len(names):
            raise InvalidArgument(f"names repeat: {sorted({n for n in names if names.count(n) > 1})}")
        self.fields, self.metadata = list(fields), dict(metadata or {})

    def __len__(self) -> int:
        return len(self.fields)

    def __eq__(self, other) -> bool:
        return isinstance(other, Schema) and self.fields == other.fields

    __hash__ = None

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def index_of(self, name: str) -> int:
        if name not in self.names:
            raise InvalidArgument(f"no column {name}")
        return self.names.index(name)

    def field(self, name: str) -> Field:
        return self.fields[self.index_of(name)]

    def project(self, positions: list[int]) -> Schema:
        if any(not 0 <= p < len(self) for p in positions):
            raise InvalidArgument(f"positions {positions} of {len(self)} columns")
        return Schema([self.fields[p] for p in positions])

    def project_by_names(self, names: list[str]) -> Schema:
        return self.project([self.index_of(n) for n in names])

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def to_json(self) -> str:
        return self.spark().json()

    def accepts(self, other: Schema) -> bool:
        return len(self) == len(other) and all(a.accepts(b) for a, b in zip(self.fields, other.fields, strict=True))


_BACK = {"boolean": "boolean", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "string", "binary": "binary", "date": "date32", "void": "null"}


def kind_of(data_type: T.DataType) -> Kind:
    """The kind that a Spark type stores when no metadata says more."""
    text = data_type.simpleString()
    if text in _BACK:
        return Kind(_BACK[text])
    if isinstance(data_type, T.DecimalType):
        return decimal(data_type.precision, data_type.scale)
    if isinstance(data_type, T.TimestampNTZType):
        return timestamp("us")
    if isinstance(data_type, T.TimestampType):
        return timestamp("us", "UTC")
    if isinstance(data_type, T.TimeType):
        return time()
    if isinstance(data_type, T.ArrayType):
        return list_of(kind_of(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return map_of(kind_of(data_type.keyType), kind_of(data_type.valueType))
    if isinstance(data_type, T.StructType):
        return Kind("struct", (), tuple((f.name, kind_of(f.dataType)) for f in data_type))
    raise InvalidArgument(f"no kind for {text}")


def schema_of(df: DataFrame) -> Schema:
    return Schema([Field(f.name, kind_of(f.dataType), f.nullable, dict(f.metadata or {})) for f in df.schema])


def checked(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` with the schema's metadata, failing at run time on values that its kinds can't hold."""
    if df.columns != schema.names:
        raise SchemaMismatch(f"{df.columns} are not {schema.names}")
    out = []
    for field in schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.kind
        fits = None
        if kind.name in UNSIGNED_BITS:
            fits = (column >= 0) & (column < F.lit(2 ** UNSIGNED_BITS[kind.name]).cast("decimal(20,0)"))
        elif kind.name == "fixed_binary":
            fits = F.octet_length(column) == kind.args[0]
        elif kind.name == "fixed_list":
            fits = F.size(column) == kind.args[0]
        elif kind.name == "tensor":
            shape = column["shape"]
            fits = F.size(shape) == len(kind.args[0])
            for i, length in enumerate(kind.args[0]):
                if length:
                    fits = fits & (F.get(shape, F.lit(i)) == length)
            fits = fits & (F.aggregate(shape, F.lit(1), lambda a, b: a * b) == F.size(column["data"]))
        if fits is not None:
            wrong = F.raise_error(F.lit(f"a value of {field.name} is no {kind.text()}"))
            column = F.when(column.isNull() | fits, column).otherwise(wrong.cast(df.schema[field.name].dataType))
        out.append(column.alias(field.name, metadata=field.spark().metadata))
    return df.select(*out)
