import pytest
from pyspark.sql import types as T

from loomwork import types as K
from loomwork.errors import InvalidArgument, SchemaMismatch


def test_spark_types():
    assert K.simple("uint64").spark() == T.DecimalType(20, 0)
    assert K.simple("uint8").spark() == T.ShortType()
    assert K.timestamp("us").spark() == T.TimestampNTZType()
    assert K.timestamp("us", "UTC").spark() == T.TimestampType()
    assert K.list_of(K.simple("int32")).spark() == T.ArrayType(T.IntegerType())
    assert K.map_of(K.simple("string"), K.simple("int8")).spark() == T.MapType(T.StringType(), T.ByteType())
    assert [f.name for f in K.tensor_of(K.simple("float32"), (0, 3)).spark()] == ["shape", "data"]
    assert [f.name for f in K.union_of(K.simple("int8"), K.simple("string")).spark()] == ["tag", "f0", "f1"]
    for bad in (lambda: K.simple("int128"), lambda: K.decimal(39, 0), lambda: K.timestamp("h"), lambda: K.sparse_tensor_of(K.simple("int8"), (1,), "xyz")):
        with pytest.raises(InvalidArgument):
            bad()


def test_accepts():
    i, s, n = K.simple("int8"), K.simple("string"), K.simple("null")
    assert i.accepts(K.simple("float64")) and i.accepts(n) and n.accepts(s) and not i.accepts(s)
    assert K.list_of(i, 3).accepts(K.list_of(K.simple("int64"), 4))
    assert not K.list_of(i).accepts(K.list_of(s))
    assert K.struct_of(a=i).accepts(K.struct_of(b=K.simple("int16"))) and not K.struct_of(a=i).accepts(K.struct_of(a=i, b=i))
    assert K.union_of(i, s).accepts(K.union_of(i, s)) and not K.union_of(i, s).accepts(K.union_of(i, i))
    assert K.Field("a", i, True).accepts(K.Field("a", i, False)) and not K.Field("a", i, False).accepts(K.Field("a", i, True))


def test_schema(spark):
    schema = K.Schema([K.Field("id", K.simple("int32"), False), K.Field("name", K.simple("string")), K.Field("ok", K.simple("boolean"))])
    assert schema.project([2, 0]).names == ["ok", "id"] and schema.project_by_names(["name"]).names == ["name"]
    assert T.StructType.fromJson(__import__("json").loads(schema.to_json())) == schema.spark()
    for bad in (lambda: schema.project([3]), lambda: schema.index_of("x"), lambda: K.Schema([schema.fields[0]] * 2)):
        with pytest.raises(InvalidArgument):
            bad()
    df = spark.createDataFrame([(1, "a", True)], "id int, name string, ok boolean")
    assert K.schema_of(df).names == schema.names and schema.accepts(K.schema_of(df)) is False  # id isn't nullable


def test_checked(spark):
    schema = K.Schema([K.Field("u", K.simple("uint8")), K.Field("b", K.fixed_binary(2)), K.Field("l", K.list_of(K.simple("int32"), 2))])
    kind = "u smallint, b binary, l array<int>"
    good = K.checked(spark.createDataFrame([(255, b"ab", [1, 2]), (None, None, None)], kind), schema)
    assert good.count() == 2 and good.schema["u"].metadata["kind"] == "uint8" and len(good.collect()) == 2
    for row in ((256, b"ab", [1, 2]), (-1, b"ab", [1, 2]), (1, b"abc", [1, 2]), (1, b"ab", [1])):
        with pytest.raises(Exception, match="a value of"):
            K.checked(spark.createDataFrame([row], kind), schema).collect()
    with pytest.raises(SchemaMismatch):
        K.checked(spark.range(1), schema)


def test_schemas_survive_files(spark, tmp_path):
    """Names, number and types of columns come back from Parquet and from Arrow."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    schema = K.Schema([K.Field("id", K.simple("int32"), False), K.Field("name", K.simple("string")), K.Field("value", K.simple("float64"), False), K.Field("valid", K.simple("boolean"))])
    df = spark.createDataFrame([(1, "a", 1.5, None)], schema.spark())
    df.write.parquet(str(tmp_path / "p"))
    back = K.schema_of(spark.read.parquet(str(tmp_path / "p")))
    assert back.names == schema.names and [f.kind for f in back.fields] == [f.kind for f in schema.fields]
    arrow = to_arrow_schema(schema.spark())
    assert arrow.field("id").type == pa.int32() and not arrow.field("id").nullable and [f.dataType for f in from_arrow_schema(arrow)] == [f.dataType for f in schema.spark()]
    kinds = [K.list_of(K.simple("int8")), K.map_of(K.simple("string"), K.decimal(10, 2)), K.struct_of(a=K.simple("date32"), b=K.timestamp("us")), K.simple("uint64"), K.timestamp("us", "UTC"), K.extension_of("x", K.simple("binary"), b"p"), K.dictionary_of(K.simple("int8"), K.simple("string"))]
    wide = K.Schema([K.Field(f"c{i}", k) for i, k in enumerate(kinds)])
    spark.createDataFrame([tuple([None] * len(kinds))], wide.spark()).write.parquet(str(tmp_path / "w"))
    again = spark.read.parquet(str(tmp_path / "w"))
    assert [f.dataType for f in again.schema] == [f.dataType for f in wide.spark()] and again.schema["c3"].metadata["kind"] == "uint64"
