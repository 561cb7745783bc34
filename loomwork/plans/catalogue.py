"""The query catalogue: each query, made with the library's own calls, beside the DuckDB SQL that checks it."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import dictionary, strings, tensor, timeseries
from loomwork.functions.timeseries import Frequency
from loomwork.operators import encoders, predicates, registry, relational, rows
from loomwork.operators.dataset import Dataset, DatasetBuilder
from loomwork.operators.pipeline import Chain, Transform
from loomwork.operators.predicates import Predicates, all_of, any_of, filter_rows, negate
from loomwork.plans import files
from loomwork.session import load_table
from loomwork.sources import detect
from loomwork.sources.infer import kind_of, typed

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, folder) -> DataFrame under ``name``, with its SQL if SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def filtered(spark, folder, table, test, columns):
    """Rows of a table that pass the test made by ``test(Predicates)``, some columns of them."""
    df = load_table(spark, folder, table)
    return rows.project_by_names(filter_rows(df, test(Predicates(df))), columns)


# Predicates.


@query("pred_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def pred_eq(spark, folder):
    return filtered(spark, folder, "orders", lambda p: p.eq("o_orderstatus", "F"), ["o_orderkey", "o_orderstatus"])


@query("pred_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def pred_ne(spark, folder):
    return filtered(spark, folder, "orders", lambda p: p.ne("o_orderstatus", "F"), ["o_orderkey"])


@query("pred_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.02 AND l_tax <= 0.05")
def pred_range(spark, folder):
    def test(p):
        return all_of([p.ge("l_quantity", "10"), p.lt("l_quantity", "20"), p.gt("l_discount", "0.02"), p.le("l_tax", "0.05")])

    return filtered(spark, folder, "lineitem", test, ["l_orderkey", "l_linenumber"])


@query("pred_null", "SELECT CAST(count_if(v IS NULL) AS BIGINT) AS n_null, CAST(count_if(v IS NOT NULL) AS BIGINT) AS n_valid FROM (SELECT nullif(event_type, 'error') AS v FROM events)")
def pred_null(spark, folder):
    df = load_table(spark, folder, "events").select(F.nullif("event_type", F.lit("error")).alias("v"))
    p = Predicates(df)
    count = lambda test: F.count_if(predicates.to_column(test))
    return df.agg(count(p.is_null("v")).alias("n_null"), count(p.is_not_null("v")).alias("n_valid"))


@query("pred_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 500)")
def pred_in(spark, folder):
    return filtered(spark, folder, "orders", lambda p: p.is_in("o_custkey", ["1", "2", "3", "500", "none"]), ["o_orderkey"])


@query("pred_not_in_null", "SELECT event_id FROM (SELECT event_id, nullif(event_type, 'error') AS v FROM events) t WHERE v NOT IN ('click')")
def pred_not_in_null(spark, folder):
    df = load_table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("v"))
    return filter_rows(df, Predicates(df).not_in("v", ["click"])).select("event_id")


@query("pred_string", "SELECT p_partkey, contains(p_type, 'CON') AS c, starts_with(p_name, 'red') AS s, ends_with(p_name, 'ring') AS e FROM part")
def pred_string(spark, folder):
    df = load_table(spark, folder, "part")
    p = Predicates(df)
    tests = {"c": p.contains("p_type", "CON"), "s": p.starts_with("p_name", "red"), "e": p.ends_with("p_name", "ring")}
    return df.select("p_partkey", *(predicates.to_column(t).alias(k) for k, t in tests.items()))


@query("pred_not_or", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 250000)")
def pred_not_or(spark, folder):
    return filtered(spark, folder, "orders", lambda p: negate(any_of([p.eq("o_orderstatus", "F"), p.gt("o_totalprice", "250000")])), ["o_orderkey"])


@query("pred_always_false", "SELECT o_orderkey FROM orders WHERE false")
def pred_always_false(spark, folder):
    return filtered(spark, folder, "orders", lambda p: p.eq("o_custkey", "not a number"), ["o_orderkey"])


@query("pred_always_true", "SELECT o_orderkey FROM orders")
def pred_always_true(spark, folder):
    return filtered(spark, folder, "orders", lambda p: negate(p.eq("no_such_column", "1")), ["o_orderkey"])


@query("pred_date_literal", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-05-24'")
def pred_date_literal(spark, folder):
    nanoseconds = str(int(datetime.datetime(1998, 5, 24, tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000_000)
    return filtered(spark, folder, "lineitem", lambda p: p.ge("l_shipdate", nanoseconds), ["l_orderkey", "l_linenumber"])


@query("filter_project_min_slice", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 25 AND l_returnflag = 'R' AND NOT (l_shipdate IS NULL)")
def filter_project_min_slice(spark, folder):
    def test(p):
        return all_of([p.ge("l_quantity", "25"), p.eq("l_returnflag", "R"), negate(p.is_null("l_shipdate"))])

    return filtered(spark, folder, "lineitem", test, ["l_orderkey", "l_partkey", "l_quantity"])


# Projections, slices and datasets.


@query("project_by_index", "SELECT c_custkey, c_acctbal FROM customer")
def project_by_index(spark, folder):
    return rows.project(load_table(spark, folder, "customer"), [0, 3])


@query("slice_rows", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rid FROM events) t WHERE rid >= 100 AND rid < 350")
def slice_rows(spark, folder):
    return Dataset(load_table(spark, folder, "events")).scan_with_projection(["event_id", "value"]).slice(["event_id"], 100, 250).df


@query("seek_rows", "SELECT event_id, CAST(rid AS BIGINT) AS row_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rid FROM events) t WHERE rid >= 9000")
def seek_rows(spark, folder):
    return rows.row_ids(load_table(spark, folder, "events").select("event_id"), ["event_id"]).filter("row_id >= 9000")


@query("collect_limit", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def collect_limit(spark, folder):
    return rows.head(load_table(spark, folder, "events").select("event_id", "event_type"), ["event_id"], 100)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, folder):
    return load_table(spark, folder, "lineitem").agg(F.count("*").alias("n"))


@query(
    "repartition_contiguous",
    """SELECT CAST(floor(rid / ceil(total / 8.0)) AS BIGINT) AS part, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi
    FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rid, count(*) OVER () AS total FROM events) t GROUP BY 1""",
)
def repartition_contiguous(spark, folder):
    parts = rows.contiguous_parts(load_table(spark, folder, "events").select("event_id"), ["event_id"], 8)
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("null_counts", "SELECT count(*) - count(v) AS v_null_count, count(*) > count(v) AS v_has_nulls FROM (SELECT nullif(event_type, 'view') AS v FROM events) t")
def null_counts(spark, folder):
    return rows.null_counts(load_table(spark, folder, "events").select(F.nullif("event_type", F.lit("view")).alias("v")))


@query("dataset_builder", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def dataset_builder(spark, folder):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return DatasetBuilder().source(lambda: load_table(spark, folder, "nation").select("n_nationkey", "n_name")).schema(schema).partitions(2).build().df


@query("transform_chain", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice > 100000")
def transform_chain(spark, folder):
    steps = [Transform(lambda df: df.filter("o_totalprice > 100000")), Transform(lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled")))]
    return Chain(steps).apply(load_table(spark, folder, "orders"))


# Inference and detection.


@query(
    "infer_types",
    r"""SELECT CASE WHEN bool_and(regexp_full_match(s, '[+-]?[0-9]+')) THEN 'Int64'
    WHEN bool_and(regexp_full_match(s, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) THEN 'Float64' ELSE 'String' END AS t
    FROM (SELECT CAST(c_custkey AS VARCHAR) AS s FROM customer) x""",
)
def infer_types(spark, folder):
    return load_table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("s")).agg(kind_of(F.col("s")).alias("t"))


@query("parse_cells", "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN '7' ELSE NULL END AS BIGINT) AS v, event_type IN ('click', 'view') AS b FROM events")
def parse_cells(spark, folder):
    cells = load_table(spark, folder, "events").select("event_id", F.when(F.col("event_type") == "click", "7").otherwise("").alias("v"), F.when(F.col("event_type").isin("click", "view"), "Yes").otherwise("f").alias("b"))
    return cells.select("event_id", typed(F.col("v"), T.LongType(), "v"), typed(F.col("b"), T.BooleanType(), "b"))


@query(
    "detect_format",
    """SELECT p, CASE list_extract(string_split(lower(p), '.'), -1) WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv' WHEN 'ndjson' THEN 'jsonl'
    WHEN 'ipc' THEN 'arrow' WHEN 'png' THEN 'image' WHEN 'gz' THEN 'csv.gz' END AS f
    FROM (VALUES ('a.csv'), ('b.TSV'), ('c.ndjson'), ('d.ipc'), ('e.png'), ('f'), ('g.csv.gz')) t(p)""",
)
def detect_format(spark, folder):
    names = spark.createDataFrame([(n,) for n in ("a.csv", "b.TSV", "c.ndjson", "d.ipc", "e.png", "f", "g.csv.gz")], "p string")
    return names.select("p", detect.path_format(F.col("p")).alias("f"))


# Strings and dictionaries.

CODES = "SELECT event_type AS value, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS code FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY event_type) x"


def event_types(spark, folder):
    return dictionary.build(load_table(spark, folder, "events"), "event_type", "event_id")


@query("dict_encode", CODES)
def dict_encode(spark, folder):
    return event_types(spark, folder)


@query("dict_encode_rows", f"SELECT e.event_id, d.code FROM events e JOIN ({CODES}) d ON e.event_type = d.value")
def dict_encode_rows(spark, folder):
    return dictionary.encode(load_table(spark, folder, "events").select("event_id", "event_type"), "event_type", event_types(spark, folder)).select("event_id", "code")


@query("dict_decode_drop_invalid", f"SELECT c.pos, d.value AS event_type FROM (SELECT * FROM (VALUES (0, 1), (1, 99), (2, 0), (3, 4)) v(pos, code)) c JOIN ({CODES}) d ON c.code = d.code")
def dict_decode_drop_invalid(spark, folder):
    codes = spark.createDataFrame([(0, 1), (1, 99), (2, 0), (3, 4)], "pos int, code int")
    return dictionary.decode(codes, "code", event_types(spark, folder), "event_type").select("pos", "event_type")


@query("dict_min_freq", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 10")
def dict_min_freq(spark, folder):
    return dictionary.frequent_values(load_table(spark, folder, "documents"), "source", 10)


@query("intern_stats", "SELECT count(*) AS n, CAST(sum(strlen(s)) AS BIGINT) AS bytes FROM (SELECT DISTINCT source AS s FROM documents) t")
def intern_stats(spark, folder):
    return strings.intern_stats(load_table(spark, folder, "documents"), "source")


@query(
    "rope_ops",
    """SELECT doc_id, substring(text, 1, 7) AS l, substring(text, 8) AS r, substring(text, 6, 10) AS sub, substring(text, 1, 5) || 'XY' || substring(text, 6) AS ins,
    CASE WHEN length(text) <= 3 THEN text ELSE substring(text, 1, 3) || substring(text, 9) END AS del, nullif(substring(text, 3, 1), '') AS ch, CAST(strlen(text) AS BIGINT) AS n_bytes, length(text) AS n_chars,
    text || source AS joined, text = '' AS empty FROM documents""",
)
def rope_ops(spark, folder):
    text = F.col("text")
    left, right = strings.split_at(text, 7)
    return load_table(spark, folder, "documents").select(
        "doc_id",
        left.alias("l"),
        right.alias("r"),
        strings.substring(text, 5, 15).alias("sub"),
        strings.insert(text, 5, F.lit("XY")).alias("ins"),
        strings.delete(text, 3, 8).alias("del"),
        strings.char_at(text, 2).alias("ch"),
        strings.byte_length(text).cast("bigint").alias("n_bytes"),
        strings.length(text).cast("bigint").alias("n_chars"),
        strings.concat(text, F.col("source")).alias("joined"),
        strings.is_empty(text).alias("empty"),
    )


@query(
    "text_lines",
    """SELECT doc_id, CAST(pos AS BIGINT) AS line_number, line AS text FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) s) t WHERE line <> ''""",
)
def text_lines(spark, folder):
    return strings.lines_of(load_table(spark, folder, "documents"), ["doc_id"], "text")


# Time series.


@query(
    "ts_metadata",
    """SELECT count(*) AS num_rows, min(ts) AS start_ts, max(ts) AS end_ts, min(d) = max(d) AS is_regular
    FROM (SELECT ts, ts - lag(ts) OVER (ORDER BY ts, event_id) AS d FROM events) t""",
)
def ts_metadata(spark, folder):
    return timeseries.metadata(load_table(spark, folder, "events"), "ts", order=["event_id"]).drop("step")


@query(
    "ts_series_metadata",
    """SELECT user_id, count(*) AS num_rows, min(ts) AS start_ts, max(ts) AS end_ts, min(d) = max(d) AS is_regular
    FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) t GROUP BY user_id""",
)
def ts_series_metadata(spark, folder):
    return timeseries.metadata(load_table(spark, folder, "events"), "ts", ["user_id"], ["event_id"]).drop("step")


@query(
    "ts_irregular_steps",
    """SELECT event_id, ts FROM (SELECT event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) t
    WHERE d > 3600000000""",
)
def ts_irregular_steps(spark, folder):
    return timeseries.irregular(load_table(spark, folder, "events"), "ts", Frequency.parse("1h"), ["user_id"], ["event_id"]).filter("step > 3600000000").select("event_id", "ts")


#: The hours of every user from the first to the last hour of the user, with the least event of each hour.
GRID = """SELECT g.user_id, g.h, o.v FROM (SELECT user_id, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS h FROM events GROUP BY user_id) g
LEFT JOIN (SELECT user_id, date_trunc('hour', ts) AS h, min(event_id) AS v FROM events GROUP BY 1, 2) o ON g.user_id = o.user_id AND g.h = o.h"""
BEFORE, AFTER = (f"OVER (PARTITION BY user_id ORDER BY h ROWS BETWEEN {rows_})" for rows_ in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))


def hourly(spark, folder):
    events = load_table(spark, folder, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.min("event_id").alias("v"))
    return timeseries.on_grid(events, "h", Frequency.parse("hourly"), ["user_id"]).select("user_id", "h", "v")


def filled(spark, folder, method):
    return timeseries.fill(hourly(spark, folder), "h", ["v"], method, ["user_id"])


@query("ts_grid", f"SELECT user_id, h, v FROM ({GRID}) t")
def ts_grid(spark, folder):
    return hourly(spark, folder)


@query("ts_fill_forward", f"SELECT user_id, h, last_value(v IGNORE NULLS) {BEFORE} AS v FROM ({GRID}) t")
def ts_fill_forward(spark, folder):
    return filled(spark, folder, "forward")


@query("ts_fill_backward", f"SELECT user_id, h, first_value(v IGNORE NULLS) {AFTER} AS v FROM ({GRID}) t")
def ts_fill_backward(spark, folder):
    return filled(spark, folder, "backward")


LINEAR = f"""SELECT user_id, h, round(CASE WHEN v IS NOT NULL THEN v ELSE pv + (nv - pv) * (e - pe) / (ne - pe) END, 6) AS v FROM (
    SELECT user_id, h, e, v, last_value(v IGNORE NULLS) {BEFORE} AS pv, first_value(v IGNORE NULLS) {AFTER} AS nv,
      last_value(ve IGNORE NULLS) {BEFORE} AS pe, first_value(ve IGNORE NULLS) {AFTER} AS ne
    FROM (SELECT user_id, h, CAST(v AS DOUBLE) AS v, CAST(epoch(h) AS DOUBLE) AS e, CASE WHEN v IS NOT NULL THEN CAST(epoch(h) AS DOUBLE) END AS ve FROM ({{}}) t) a) b"""


@query("ts_fill_linear", LINEAR.format(GRID))
def ts_fill_linear(spark, folder):
    return filled(spark, folder, "linear").select("user_id", "h", F.round("v", 6).alias("v"))


#: One series without keys: the minutes of all events, with the least event of each.
MINUTES = """SELECT 0 AS user_id, g.h, o.v FROM (SELECT unnest(generate_series(min(date_trunc('minute', ts)), max(date_trunc('minute', ts)), INTERVAL 1 MINUTE)) AS h FROM events) g
LEFT JOIN (SELECT date_trunc('minute', ts) AS h, min(event_id) AS v FROM events GROUP BY 1) o ON g.h = o.h"""


def minutely(spark, folder):
    events = load_table(spark, folder, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("h")).agg(F.min("event_id").alias("v"))
    return timeseries.on_grid(events, "h", Frequency.parse("minutely")).select("h", "v")


@query("ts_fill_one_series", f"SELECT h, last_value(v IGNORE NULLS) {BEFORE} AS f, first_value(v IGNORE NULLS) {AFTER} AS b FROM ({MINUTES}) t")
def ts_fill_one_series(spark, folder):
    both = minutely(spark, folder).select("h", F.col("v").alias("f"), F.col("v").alias("b"))
    return timeseries.fill(timeseries.fill(both, "h", ["f"], "forward"), "h", ["b"], "backward")


@query("ts_fill_one_series_linear", f"SELECT h, v FROM ({LINEAR.format(MINUTES)})")
def ts_fill_one_series_linear(spark, folder):
    return timeseries.fill(minutely(spark, folder), "h", ["v"], "linear").select("h", F.round("v", 6).alias("v"))


@query("ts_fill_zero", f"SELECT user_id, h, coalesce(v, 0) AS v FROM ({GRID}) t")
def ts_fill_zero(spark, folder):
    return filled(spark, folder, "zero")


@query("ts_fill_nan", f"SELECT user_id, h, isnan(coalesce(CAST(v AS DOUBLE), CAST('nan' AS DOUBLE))) AS gap FROM ({GRID}) t")
def ts_fill_nan(spark, folder):
    return filled(spark, folder, "nan").select("user_id", "h", F.isnan("v").alias("gap"))


# Tensors.

SHAPE = [8, 8]


def tensors(spark, folder):
    return load_table(spark, folder, "embeddings").select("vec_id", tensor.dense(F.col("embedding"), SHAPE).alias("t"))


@query("tensor_get", "SELECT vec_id, embedding[2 * 8 + 3 + 1] AS x FROM embeddings")
def tensor_get(spark, folder):
    return tensors(spark, folder).select("vec_id", tensor.get(F.col("t"), SHAPE, [2, 3]).alias("x"))


@query("tensor_slice", "SELECT vec_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS p, unnest(a) AS x FROM (SELECT vec_id, list_concat(embedding[18:19], embedding[26:27]) AS a FROM embeddings) t")
def tensor_slice(spark, folder):
    part = tensor.slice_of(F.col("t"), SHAPE, [(2, 4), (1, 3)])
    return tensors(spark, folder).select("vec_id", F.posexplode(part["data"]).alias("p", "x"))


@query("tensor_reshape", "SELECT vec_id, 64 AS n, 2 AS dims, embedding[2 * 16 + 5 + 1] AS x FROM embeddings")
def tensor_reshape(spark, folder):
    t = tensor.reshape(F.col("t"), [4, 16])
    return tensors(spark, folder).select("vec_id", tensor.length(t).cast("int").alias("n"), tensor.ndim(t).alias("dims"), tensor.get(t, [4, 16], [2, 5]).alias("x"))


def sparse(spark, folder):
    return tensors(spark, folder).select("vec_id", tensor.coo_of(F.col("t"), SHAPE, lambda v: F.abs(v) > 0.2).alias("s"))


@query("sparse_coo", "SELECT vec_id, CAST(p AS BIGINT) AS p, x FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS p, unnest(embedding) AS x FROM embeddings) t WHERE abs(x) > 0.2")
def sparse_coo(spark, folder):
    s = F.col("s")
    cells = F.transform(s["values"], lambda v, i: F.struct((F.element_at(s["indices"], i * 2 + 1) * 8 + F.element_at(s["indices"], i * 2 + 2)).alias("p"), v.alias("x")))
    return sparse(spark, folder).select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.p", "c.x")


@query("sparse_to_dense", "SELECT vec_id, CAST(p AS INT) AS p, CASE WHEN abs(x) > 0.2 THEN x ELSE 0 END AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS x FROM embeddings) t")
def sparse_to_dense(spark, folder):
    out = tensor.to_dense(F.col("s"), SHAPE, "coo", "float")["data"]
    return sparse(spark, folder).select("vec_id", F.posexplode(out).alias("p", "x"))


@query(
    "sparse_csr",
    """SELECT vec_id, CAST(p AS INT) AS p, CASE WHEN abs(x) > 0.2 THEN x ELSE 0 END AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS x FROM embeddings) t""",
)
def sparse_csr(spark, folder):
    """Compressed rows made from the dense tensor by tensor.csr, and back."""
    data = F.col("t")["data"]
    kept = F.filter(F.transform(data, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: F.abs(c["v"]) > 0.2)
    cells = tensors(spark, folder).select("vec_id", kept.alias("cells"))
    indptr = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda r: F.size(F.filter("cells", lambda c: c["i"] < r * 8)))
    parts = cells.select("vec_id", indptr.alias("indptr"), F.transform("cells", lambda c: c["i"] % 8).alias("indices"), F.transform("cells", lambda c: c["v"]).alias("values"))
    made = parts.select("vec_id", tensor.csr(F.col("indptr"), F.col("indices"), F.col("values"), SHAPE).alias("s"))
    return made.select("vec_id", F.posexplode(tensor.to_dense(F.col("s"), SHAPE, "csr", "float")["data"]).alias("p", "x"))


@query("tensor_put_strides", "SELECT vec_id, CAST(7.5 AS FLOAT) AS x, embedding[1] AS first, 32 AS row_bytes, 4 AS cell_bytes, 256 AS n_bytes, false AS empty FROM embeddings")
def tensor_put_strides(spark, folder):
    changed = tensor.put(F.col("t"), SHAPE, [2, 3], F.lit(7.5).cast("float"))
    strides = tensor.strides(changed, "float")
    return tensors(spark, folder).select(
        "vec_id", tensor.get(changed, SHAPE, [2, 3]).alias("x"), tensor.get(changed, SHAPE, [0, 0]).alias("first"), strides[0].cast("int").alias("row_bytes"), strides[1].cast("int").alias("cell_bytes"),
        tensor.size_bytes(changed, "float").cast("int").alias("n_bytes"), tensor.is_empty(changed).alias("empty"),
    )


@query(
    "sparse_csr_indptr",
    """SELECT vec_id, CAST(sum(nnz) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS indptr_end
    FROM (SELECT vec_id, len(list_filter(embedding, lambda x : abs(x) > 0.2)) AS nnz FROM embeddings) t""",
)
def sparse_csr_indptr(spark, folder):
    counts = sparse(spark, folder).select("vec_id", tensor.nnz(F.col("s")).alias("nnz"))
    blocks = counts.withColumn("block", F.floor(F.col("vec_id") / 4096))
    inside = blocks.withColumn("run", F.sum("nnz").over(relational.W.partitionBy("block").orderBy("vec_id")))
    ends = blocks.groupBy("block").agg(F.sum("nnz").alias("n"))
    before = F.coalesce(F.sum("n").over(relational.W.orderBy("block").rowsBetween(relational.W.unboundedPreceding, -1)), F.lit(0))
    return inside.join(ends.select("block", before.alias("before")), "block").select("vec_id", (F.col("run") + F.col("before")).cast("bigint").alias("indptr_end"))


# Extensions: relational operators beyond the reader's contract.


@query("ext_join_aggregate", "SELECT n.n_name, count(*) AS n, CAST(sum(CAST(o.o_totalprice * 100 AS BIGINT)) AS BIGINT) AS cents FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def ext_join_aggregate(spark, folder):
    orders, customer, nation = (load_table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(relational.broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query(
    "ext_asof_join",
    """SELECT e.event_id, max(p.event_id) AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') p ON p.user_id = e.user_id
      AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.event_type = 'click' AND q.user_id = e.user_id AND q.ts <= e.ts)
    GROUP BY e.event_id""",
)
def ext_asof_join(spark, folder):
    events = load_table(spark, folder, "events")
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_click"))
    return relational.asof_join(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "ts", ["last_click"]).select("event_id", "last_click")


@query("ext_top_per_group", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) t WHERE r <= 3")
def ext_top_per_group(spark, folder):
    return relational.top_per_group(load_table(spark, folder, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), "event_id"], 3).drop("value")


@query(
    "ext_sessions",
    """SELECT user_id, CAST(max(s) AS BIGINT) AS sessions FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR >= ts THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id""",
)
def ext_sessions(spark, folder):
    found = relational.sessions(load_table(spark, folder, "events"), ["user_id"], "ts", "6 hours", ["event_id"])
    return found.groupBy("user_id").agg(F.max("session").cast("bigint").alias("sessions"))


@query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, folder):
    return load_table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))


@query("ext_one_hot", "SELECT event_id, CAST(event_type = 'click' AS INT) AS event_type_click, CAST(event_type <> 'click' AS INT) AS event_type_not FROM events")
def ext_one_hot(spark, folder):
    events = load_table(spark, folder, "events").select("event_id", "event_type")
    hot = encoders.one_hot(events, "event_type", 10)
    return hot.select("event_id", "event_type_click", (1 - F.col("event_type_click")).alias("event_type_not"))


@query("ext_left_join", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 GROUP BY c.c_custkey")
def ext_left_join(spark, folder):
    customer, orders = load_table(spark, folder, "customer"), load_table(spark, folder, "orders").filter("o_totalprice > 400000")
    return customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("ext_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ext_semi_join(spark, folder):
    orders = load_table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return load_table(spark, folder, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("ext_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ext_anti_join(spark, folder):
    orders = load_table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return load_table(spark, folder, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("ext_outer_join", "SELECT n.n_name, s.s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey > 3) n FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_nationkey = n.n_nationkey")
def ext_outer_join(spark, folder):
    nation, supplier = load_table(spark, folder, "nation").filter("n_nationkey > 3"), load_table(spark, folder, "supplier").filter("s_acctbal > 0")
    return nation.join(supplier.hint("merge"), F.col("s_nationkey") == F.col("n_nationkey"), "full").select("n_name", "s_suppkey")


@query("ext_range_join", "SELECT p.p_partkey, CAST(r.low AS INT) AS low FROM part p JOIN (SELECT unnest(range(0, 50, 5)) AS low) r ON p.p_size >= r.low AND p.p_size < r.low + 7")
def ext_range_join(spark, folder):
    ranges = spark.range(10).select((F.col("id") * 5).cast("int").alias("low"), (F.col("id") * 5 + 7).cast("int").alias("high"))
    return relational.range_join(load_table(spark, folder, "part"), ranges, "p_size", "low", "high", 7.0).select("p_partkey", "low")


@query("ext_set_operations", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'one', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def ext_set_operations(spark, folder):
    a, b = load_table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")), load_table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"))
    named = [(a.intersect(b), "both"), (a.subtract(b), "one"), (a.union(b).distinct(), "any")]
    parts = [df.select(F.lit(name).alias("kind"), "k") for df, name in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ext_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def ext_distinct(spark, folder):
    return load_table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("ext_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, p_size % 7 AS rest, round(power(p_size, 1.5), 6) AS pw, CAST(floor(p_retailprice / 10) AS BIGINT) AS tens, abs(p_size - 25) AS off FROM part")
def ext_math(spark, folder):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return load_table(spark, folder, "part").select(
        "p_partkey", F.round(F.sqrt(price), 6).alias("root"), (size % 7).alias("rest"), F.round(F.pow(size, 1.5), 6).alias("pw"), F.floor(price / 10).cast("bigint").alias("tens"), F.abs(size - 25).alias("off")
    )


@query("ext_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, date_trunc('month', o_orderdate) AS start, CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS INT) AS days, o_orderdate + INTERVAL 90 DAY AS due FROM orders")
def ext_dates(spark, folder):
    at = F.col("o_orderdate")
    return load_table(spark, folder, "orders").select(
        "o_orderkey", F.year(at).alias("y"), F.month(at).alias("m"), F.date_trunc("month", at).cast("timestamp_ntz").alias("start"), F.datediff(F.lit("2002-01-01").cast("date"), at.cast("date")).alias("days"), (at + F.expr("interval 90 days")).alias("due")
    )


@query("ext_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS missing FROM events")
def ext_json(spark, folder):
    props = F.from_json("props", "k bigint")
    return load_table(spark, folder, "events").select("event_id", props["k"].alias("k"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("ext_maps", "SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY user_id, event_type")
def ext_maps(spark, folder):
    counted = load_table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("by_kind"))
    return maps.select("user_id", F.explode(F.map_filter("by_kind", lambda _, n: n > 0)).alias("kind", "n"))


STATEMENT = """SELECT n.n_name, count(*) AS suppliers, round(avg(s.s_acctbal), 4) AS balance FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_name HAVING count(*) > 0"""


@query("ext_sql", STATEMENT.format(supplier="supplier", nation="nation"))
def ext_sql(spark, folder):
    return registry.run_sql(spark, STATEMENT, supplier=load_table(spark, folder, "supplier"), nation=load_table(spark, folder, "nation"))


@query("registered_function", "SELECT p_partkey, p_size * 2 + 1 AS odd FROM part")
def registered_function(spark, folder):
    registry.register_function(spark, "odd_of", [("x", "int")], "int", "x * 2 + 1")
    return load_table(spark, folder, "part").select("p_partkey", F.expr("odd_of(p_size)").alias("odd"))


@query("registered_source", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def registered_source(spark, folder):
    sources, transforms = registry.Registry("source"), registry.Registry("transform")
    sources.register("tables", load_table)
    transforms.register("region", lambda key: Transform(lambda df: df.filter(F.col("n_regionkey") == key).select("n_name")))
    return transforms.create("region", 1).apply(sources.create("tables", spark, folder, "nation"))


QUERIES |= files.QUERIES
ORACLE |= files.ORACLE
