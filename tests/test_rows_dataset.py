import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import InvalidArgument, SchemaMismatch
from loomwork.operators import encoders, relational, rows
from loomwork.operators.dataset import Dataset, DatasetBuilder
from loomwork.operators.pipeline import BatchTransform, Cancelled, Chain, Pipeline, Settings, Transform
from loomwork.operators.predicates import Predicates


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(0, 1003, 1, 7).select((F.col("id") * 7 % 1003).alias("k"), (F.col("id") % 5).cast("string").alias("s"))


def test_projection(numbers):
    assert rows.project(numbers, [1, 0, 1]).columns == ["s", "k", "s"]
    for bad in (lambda: rows.project(numbers, [2]), lambda: rows.project_by_names(numbers, ["x"]), lambda: rows.slice_rows(numbers, ["k"], -1, 2)):
        with pytest.raises(InvalidArgument):
            bad()
    assert [r.k for r in rows.slice_rows(numbers, ["k"], 5, 3).collect()] == [5, 6, 7] and rows.slice_rows(numbers, ["k"], 2000, 3).count() == 0
    with pytest.raises(SchemaMismatch):
        rows.relabel(numbers, ["a"])


def test_row_ids(numbers, spark):
    found = rows.row_ids(numbers, ["k"], parts=5).collect()
    assert sorted((r.k, r.row_id) for r in found) == [(i, i) for i in range(1003)]
    assert rows.row_ids(numbers.filter("k < 0"), ["k"]).count() == 0
    pairs = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "s string, n int")
    assert sorted((r.s, r.n, r.row_id) for r in rows.row_ids(pairs, ["s", "n"]).collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2)]


def test_contiguous(numbers):
    sizes = {r.part: (r.n, r.lo, r.hi) for r in rows.contiguous_parts(numbers, ["k"], 4).groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
    assert sizes == {0: (251, 0, 250), 1: (251, 251, 501), 2: (251, 502, 752), 3: (250, 753, 1002)}
    ordered = rows.repartition_in_order(numbers, ["k"], 4)
    assert [r.k for r in ordered.collect()] == list(range(1003))
    with pytest.raises(InvalidArgument):
        rows.contiguous_parts(numbers, ["k"], 0)


def test_dataset(spark, numbers):
    data = Dataset.from_batches(spark, [pa.record_batch({"a": [1, 2], "b": ["x", None]}), pa.record_batch({"a": [3], "b": ["z"]})])
    assert data.row_count() == 3 and sum(b.num_rows for b in data.batches()) == 3 and data.cache().row_count() == 3
    assert data.scan_with_filter(Predicates(data.df).gt("a", "1")).row_count() == 2
    assert data.scan_with_filter(lambda batch: batch.slice(0, 0)).row_count() == 0
    assert data.scan_with_projection(["b"]).schema.names == ["b"] and data.with_schema(["c", "d"]).schema.names == ["c", "d"]
    assert data.repartition(2).df.rdd.getNumPartitions() == 2 and "a:bigint" in str(data) and data.size_in_bytes() > 0
    with pytest.raises(InvalidArgument):
        data.repartition(0)
    with pytest.raises(InvalidArgument):
        DatasetBuilder().build()
    schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("text", T.StringType())])
    built = DatasetBuilder().source(numbers).schema(schema).partitions(3, ["key"]).cached().metadata(origin="test").build()
    assert built.metadata == {"origin": "test"} and built.schema["key"].dataType == T.IntegerType() and built.row_count() == 1003


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows.null_counts(df).first().asDict() == {"a_null_count": 1, "a_has_nulls": True, "b_null_count": 2, "b_has_nulls": True}


def test_pipeline(spark, numbers):
    def halves(batches):
        for batch in batches:
            yield batch.filter(pa.compute.less(batch.column("k"), 500))

    chain = Chain([Transform(lambda d: d.filter("k >= 100"))]).add(BatchTransform(halves, "k bigint, s string", parallel=False))
    assert not chain.parallel and chain.keeps_order and chain.output_schema(numbers.schema, spark).names == ["k", "s"]
    run = Pipeline(lambda: numbers, chain, lambda df: df.collect())
    assert len(run.run()) == 400 and run.statistics.rows_in == 1003 and run.statistics.rows_out == 400 and run.statistics.run_seconds > 0
    run.cancel()
    with pytest.raises(Cancelled):
        run.run()
    with pytest.raises(InvalidArgument):
        Pipeline(numbers, chain, None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tuned = Pipeline(numbers, BatchTransform(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n bigint"), lambda df: max(r.n for r in df.collect()), Settings(batch_rows=50))
    assert tuned.run() == 50
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with pytest.raises(InvalidArgument):
        Settings(batch_rows=0).apply(spark)


def test_encoders(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 3.0), ("c", 3.0)], "v string, x double")
    hot = encoders.one_hot(df, "v", 2).collect()
    assert [(r.v_a, r.v_b, r.v_other) for r in hot] == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)]
    scaled = [r.x for r in encoders.standardize(df, ["x"]).collect()]
    assert abs(sum(scaled)) < 1e-9 and scaled[1] == 0
    assert encoders.tokenize(spark.createDataFrame([("Ab c-D é1",)], "t string"), "t").first().tokens == ["ab", "c", "d", "é1"]


def test_relational(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 4, "b"), (1, 6, "c")], "k int, u int, v string")
    assert sorted(map(tuple, relational.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()), key=str) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    ranges = spark.createDataFrame([(0.0, 10.0, "x"), (3.0, 5.0, "y")], "a double, b double, n string")
    points = spark.createDataFrame([(4.0,), (5.0,), (10.0,)], "p double")
    assert sorted((r.p, r.n) for r in relational.range_join(points, ranges, "p", "a", "b", 2.0).collect()) == [(4.0, "x"), (4.0, "y"), (5.0, "x")]
