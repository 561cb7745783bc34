"""Queries of readers, sinks, datasets, pipelines and streams: tables are written to the shared folder and read again."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.timeseries import Frequency
from loomwork.operators.dataset import Dataset
from loomwork.operators.pipeline import Pipeline, Transform
from loomwork.operators.predicates import Predicates, can_push_down, filter_rows, row_groups_left
from loomwork.session import load_table, shared_folder
from loomwork.sources import detect, readers, sinks, tfrecord
from loomwork.sources.infer import infer_records
from loomwork.streaming import streams

QUERIES = {}
ORACLE = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE[function.__name__] = function, sql
        return function

    return add


def scratch(spark, name: str) -> str:
    """A new path in the shared folder; a plain one where that is local, for readers beside Spark's."""
    return re.sub("^file:/+", "/", f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


ORDERS = "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority"


@query(f"SELECT {ORDERS} FROM orders")
def csv_inferred(spark, folder):
    path = scratch(spark, "csv")
    sinks.write_csv(load_table(spark, folder, "orders").selectExpr(*ORDERS.split(", ")), path)
    return readers.read_csv(spark, path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_with_schema(spark, folder):
    """Without a header, with another delimiter and all cells quoted; some columns of a given schema."""
    path = scratch(spark, "csv")
    customer = load_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    sinks.write_csv(customer, path, header=False, delimiter=";", quote_all=True)
    return readers.read_csv(spark, path, customer.schema, header=False, delimiter=";", columns=["c_custkey", "c_name", "c_acctbal"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines(spark, folder):
    path = scratch(spark, "json")
    nation = load_table(spark, folder, "nation")
    nation.write.json(path)
    return readers.read_json(spark, path, nation.schema, multiline=False)


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS line_number, p_name AS text FROM part")
def text_file_lines(spark, folder):
    path = scratch(spark, "text")
    load_table(spark, folder, "part").orderBy("p_partkey").select("p_name").coalesce(1).write.text(path)
    return readers.read_text(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def arrow_files(spark, folder):
    path = scratch(spark, "arrow")
    sinks.write_arrow(load_table(spark, folder, "customer").repartition(3), path)
    return readers.read_arrow(spark, path)


@query(
    """SELECT n_name AS name, CAST(strlen(n_name) AS INT) AS length, CAST(sum(strlen(n_name) + 16) OVER (ORDER BY n_nationkey) - strlen(n_name) - 16 AS BIGINT) AS place FROM nation"""
)
def framed_records(spark, folder):
    path = scratch(spark, "records")
    names = [r.n_name.encode() for r in load_table(spark, folder, "nation").orderBy("n_nationkey").collect()]
    os.makedirs(path)
    with open(f"{path}/nation.tfrecord", "wb") as out:
        out.write(tfrecord.framed(names))
    return tfrecord.read_tfrecords(spark, path).select(F.col("data").cast("string").alias("name"), "length", F.col("offset").alias("place"))


@query("SELECT c.name AS codec, p_partkey, p_size FROM part, (VALUES ('snappy'), ('zstd'), ('gzip'), ('uncompressed')) c(name) WHERE p_size < 20")
def parquet_codecs(spark, folder):
    """Parquet files of each codec, with Bloom filters, read by columns and a predicate."""
    part, out = load_table(spark, folder, "part"), None
    for codec in ("snappy", "zstd", "gzip", "uncompressed"):
        path = scratch(spark, codec)
        sinks.write_parquet(part, path, compression=codec, bloom_filters=["p_partkey"], row_group_bytes=1 << 20)
        found = readers.read_parquet(spark, path, ["p_partkey", "p_size"], Predicates(part).lt("p_size", "20")).withColumn("codec", F.lit(codec))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT count(*) AS num_rows, 2 AS num_columns FROM events")
def parquet_footer(spark, folder):
    path = scratch(spark, "parquet")
    sinks.write_parquet(load_table(spark, folder, "events").select("event_id", "value").coalesce(1), path)
    footer = readers.parquet_metadata(next(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".parquet")))
    return spark.createDataFrame([(footer["num_rows"], footer["num_columns"])], "num_rows bigint, num_columns int")


@query("SELECT event_id, value, true AS skipped FROM events WHERE event_id >= (SELECT count(*) * 9 // 10 FROM events)")
def row_groups_skipped(spark, folder):
    """Rows of the row groups that statistics leave, and whether they left out some."""
    import pyarrow.parquet as pq

    events = load_table(spark, folder, "events").select("event_id", "value")
    path = f"{scratch(spark, 'groups')}.parquet"
    pq.write_table(events.orderBy("event_id").toArrow(), path, row_group_size=100)
    test = Predicates(events).ge("event_id", str(events.count() * 9 // 10))
    left = row_groups_left(path, test)
    kept = spark.createDataFrame(pq.ParquetFile(path).read_row_groups(left))
    return filter_rows(kept, test).withColumn("skipped", F.lit(0 < len(left) < pq.read_metadata(path).num_row_groups))


@query("SELECT * FROM (VALUES ('eq', true), ('in', false), ('contains', false), ('is_null', true), ('both', true), ('mixed', false)) t(test, pushed)")
def pushed_predicates(spark, folder):
    p = Predicates(load_table(spark, folder, "part"))
    tests = {"eq": p.eq("p_size", "1"), "in": p.is_in("p_size", ["1", "2"]), "contains": p.contains("p_name", "a"), "is_null": p.is_null("p_name"), "both": p.eq("p_size", "1") & p.gt("p_partkey", "5"), "mixed": p.eq("p_size", "1") & p.contains("p_name", "a")}
    return spark.createDataFrame([(k, can_push_down(t)) for k, t in tests.items()], "test string, pushed boolean")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0")
def filtered_by_function(spark, folder):
    import pyarrow.compute as pc

    part = Dataset(load_table(spark, folder, "part").select("p_partkey", "p_size"))
    return part.scan_with_filter(lambda batch: batch.filter(pc.equal(pc.bit_wise_and(batch.column("p_size"), 1), 0))).df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dataset_of_batches(spark, folder):
    nation = Dataset(load_table(spark, folder, "nation"), {"of": "nation"})
    return Dataset.from_batches(spark, list(nation.batches())).cache().scan()


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7")
def collected_rows(spark, folder):
    found = sinks.collect_rows(load_table(spark, folder, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], 7)
    return spark.createDataFrame(found, "s_suppkey bigint, s_name string")


@query("SELECT r_regionkey, r_name FROM region")
def collected_arrow(spark, folder):
    return spark.createDataFrame(sinks.collect_arrow(load_table(spark, folder, "region")))


@query("SELECT count(*) AS rows_in, count_if(o_totalprice > 100000) AS rows_out, count_if(o_totalprice > 100000) AS written FROM orders")
def pipeline_statistics(spark, folder):
    path = scratch(spark, "pipeline")
    run = Pipeline(lambda: load_table(spark, folder, "orders"), Transform(lambda df: df.filter("o_totalprice > 100000")), lambda df: df.write.parquet(path))
    run.run()
    return spark.createDataFrame([(run.statistics.rows_in, run.statistics.rows_out, spark.read.parquet(path).count())], "rows_in bigint, rows_out bigint, written bigint")


@query("SELECT * FROM (VALUES ('h', 3600000000000), ('5min', 300000000000), ('daily', 86400000000000), ('2w', 1209600000000000), ('ms', 1000000), ('q', 7862400000000000)) t(name, ns)")
def frequencies(spark, folder):
    names = ("h", "5min", "daily", "2w", "ms", "q")
    return spark.createDataFrame([(n, Frequency.parse(n).nanoseconds) for n in names], "name string, ns bigint")


@query("SELECT user_id, ts, value FROM events")
def timeseries_files(spark, folder):
    """Times as whole microseconds since 1970, as CSV."""
    path = scratch(spark, "series")
    sinks.write_csv(load_table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value"), path)
    return readers.read_timeseries(spark, path, "csv", "ts", ["value"], ["user_id"], time_unit="us")


@query("SELECT * FROM (VALUES ('a', 'parquet'), ('b', 'arrow'), ('c', 'json'), ('d', 'csv'), ('e', 'gz'), ('f', 'binary'), ('g.csv', 'csv')) t(name, format)")
def detected_by_content(spark, folder):
    path = scratch(spark, "detect")
    os.makedirs(path)
    heads = {"a": b"PAR1....", "b": b"ARROW1..", "c": b'{"k": 1}', "d": b"x,y\n1,2\n", "e": b"\x1f\x8b\x08\x00", "f": b"plain words", "g.csv": b"no commas"}
    for name, head in heads.items():
        with open(f"{path}/{name}", "wb") as out:
            out.write(head)
    found = detect.detect_files(spark, [path])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "format")


@query("SELECT * FROM (VALUES ('a', 'bigint'), ('b', 'double'), ('c', 'boolean'), ('d', 'string'), ('e', 'string')) t(name, kind)")
def inferred_records(spark, folder):
    schema = infer_records([["1", "1.5", "true", "x", ""], ["-2", "", "no", "1", ""]], ["a", "b", "c", "d", "e"])
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "name string, kind string")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, folder):
    """Daily counts of a stream of files, several micro-batches of it."""
    source, target = scratch(spark, "stream"), scratch(spark, "windows")
    events = load_table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3).write.parquet(source)
    counts = streams.windowed(streams.stream_files(spark, source, events.schema, most_files=1), "ts", "1 day", [F.count("*").alias("n")], ["event_type"], late="60 days")
    run = streams.Stream.start(counts, lambda batch, _: batch.write.mode("overwrite").parquet(target), scratch(spark, "progress"), mode="complete")
    run.wait()
    return spark.read.parquet(target).select(F.col("start").cast(T.TimestampNTZType()).alias("start"), "event_type", "n")
