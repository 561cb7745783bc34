import datetime
import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import FormatError, InvalidArgument, Unsupported
from loomwork.operators.predicates import Predicates
from loomwork.sources import detect, images, infer, readers, sinks, tfrecord


def test_detect(spark, tmp_path):
    for path, kind in (("A.CSV", "csv"), ("x/b.tsv", "csv"), ("c.jsonl", "jsonl"), ("d.ndjson", "jsonl"), ("e.arrows", "arrow"), ("f.tif", "image"), ("g.webp", "image"), ("h.csv.GZ", "csv.gz"), ("H.CSV.gz", "csv.gz"), ("i.txt.gz", "gz"), ("gz", None), ("j", None), ("k.txt", None), ("l.d/m", None)):
        assert detect.format_of_path(path) == kind
    for head, kind in ((b"PAR1....", "parquet"), (b"ARROW1\0\0", "arrow"), (b"\x1f\x8b\x08\0", "gz"), (b'{"a":1}', "json"), (b"[1,2]", "json"), (b"a,b\n1,2", "csv"), (b"a b c", "binary"), (b"a,b", "binary"), (b" " * 32 + b",", "binary")):
        assert detect.format_of_bytes(head) == kind
        (tmp_path / "file").write_bytes(head)
        assert detect.detect_files(spark, [str(tmp_path / "file")]).first().format == kind
    assert detect.format_of_bytes(b"PAR1", "a.csv") == "csv"
    names = ["A.CSV", "x.y/b", "h.csv.gz", "g.gz", "f.tif", "a.parquet.gzip"]
    found = spark.createDataFrame([(n,) for n in names], "p string").select("p", detect.path_format(F.col("p")).alias("f")).collect()
    assert {r.p: r.f for r in found} == {n: detect.format_of_path(n) for n in names}


CSV = "id,name,value\n1,Alice,10.5\n2,Bob,20.1\n3,Charlie,30.9\n"


def test_csv_reads_all_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "value"] and [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Alice", 10.5), (2, "Bob", 20.1), (3, "Charlie", 30.9)]
    (tmp_path / "b.csv").write_text(CSV.split("\n", 1)[1])
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False), T.StructField("value", T.DoubleType(), False)])
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), schema, header=False).count() == 3
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), header=False).columns == ["column_0", "column_1", "column_2"]
    assert readers.read_csv(spark, [str(tmp_path / "b.csv")] * 2, schema, header=False, columns=["id"]).count() == 6


def test_csv_inference(spark, tmp_path):
    rows = ["i;e;f;n;b;o;y;x;t", "1;1;1.5;nan;true;1;y;;a", "+2;;-2e3;inf;no;0;n;;'q;''r'"]
    (tmp_path / "a.csv").write_text("\n".join(["# note", *rows]) + "\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), delimiter=";", quote="'", comment="#")
    kinds = dict(df.dtypes)
    assert kinds == {"i": "bigint", "e": "bigint", "f": "double", "n": "double", "b": "boolean", "o": "bigint", "y": "string", "x": "string", "t": "string"}
    last = df.filter("i = 2").first()
    assert last.e is None and last.f == -2000 and last.n == float("inf") and last.b is False and last.x == "" and last.t == "q;'r"
    for bad in ("a,b\n1\n", "a\nx1\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):
            readers.read_csv(spark, str(tmp_path / "bad.csv"), T.StructType([T.StructField(c, T.LongType()) for c in bad.split("\n")[0].split(",")])).collect()
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(FormatError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_infer_records():
    found = infer.infer_records([["1", "", "yes", "nan"], ["2", "", "No", "1"]], ["a", "b", "c", "d"])
    assert [f.dataType.simpleString() for f in found] == ["bigint", "string", "boolean", "double"] and found[0].nullable
    assert infer.infer_records([["9223372036854775808"]])[0].dataType == T.DoubleType() and infer.infer_records([["1"]]).names == ["column_0"]
    for bad in (lambda: infer.infer_records([]), lambda: infer.infer_records([["1"], ["1", "2"]]), lambda: infer.infer_records([["1"]], ["a", "b"])):
        with pytest.raises(FormatError):
            bad()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y', 1.0, True), (-5, "", 1e20, False)], "i bigint, s string, d double, b boolean")
    for i, options in enumerate(({}, {"quote_all": True}, {"delimiter": "|", "single": True})):
        path = str(tmp_path / str(i))
        sinks.write_csv(df, path, **options)
        back = readers.read_csv(spark, path, df.schema, delimiter=options.get("delimiter", ","))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_parquet(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id") % 3).alias("s"))
    for codec in sinks.CODECS:
        sinks.write_parquet(df, str(tmp_path / codec), codec, bloom_filters=["s"], page_bytes=4096, row_group_bytes=1 << 16, dictionary=codec != "zstd")
        assert readers.read_parquet(spark, str(tmp_path / codec), ["id"], Predicates(df).lt("id", "10")).count() == 10
    for bad, error in ((lambda: sinks.write_parquet(df, "x", "lzo"), Unsupported), (lambda: sinks.write_parquet(df, "x", bloom_filters=["none"]), InvalidArgument)):
        with pytest.raises(error):
            bad()
    pq.write_table(pa.table({"a": [1, 2, 3]}), tmp_path / "m.parquet", row_group_size=2)
    assert readers.parquet_metadata(str(tmp_path / "m.parquet")) == {"num_rows": 3, "num_row_groups": 2, "num_columns": 1}
    assert len(sinks.collect_rows(df, ["id"], 5)) == 5 and sinks.collect_arrow(df, 7).num_rows == 7


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\n\n  two  \nlast".encode())
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n" for i in range(1, 30001)))
    assert sorted(map(tuple, readers.read_text(spark, str(tmp_path / "a.txt")).collect())) == [(1, "one"), (3, "  two  "), (4, "last")]
    assert sorted(map(tuple, readers.read_text(spark, str(tmp_path / "a.txt"), trim=True, skip_empty=False).collect()))[1:3] == [(2, ""), (3, "two")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = readers.read_text(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")], with_path=True).filter("path like '%b.txt'")
        assert found.rdd.getNumPartitions() > 1 and found.count() == 30000 and found.filter("text != concat('line ', line_number)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="more than 3 bytes"):
        readers.read_text(spark, str(tmp_path / "a.txt"), most_bytes=3).collect()


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": 3}]')
    assert readers.read_json(spark, str(tmp_path / "a.jsonl")).count() == 2 and readers.read_files(spark, str(tmp_path / "b.json")).agg(F.sum("a")).first()[0] == 4
    for bad, error in ((lambda: readers.read_files(spark, ["a.csv", "b.json"]), InvalidArgument), (lambda: readers.read_files(spark, "a.gz"), Unsupported)):
        with pytest.raises(error):
            bad()


def test_tfrecord(spark, tmp_path):
    records = [b"", b"x", b"hello world", bytes(1000)]
    data = tfrecord.framed(records)
    files = {"ok": data, "gz": gzip.compress(data), "z": zlib.compress(data), "tail": data + b"\x01\x02", "cut": data[:-5], "head": data + struct.pack("<QH", 3, 1), "crc": data[:14] + b"?" + data[15:], "empty": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = lambda name, **o: [(bytes(r.data), r.offset, r.length) for r in tfrecord.read_tfrecords(spark, str(tmp_path / name), **o).orderBy("offset").collect()]
    expected = [(r, o, len(r)) for r, o in zip(records, (0, 16, 33, 60), strict=True)]
    assert read("ok") == read("gz", compression="gzip") == read("z", compression="zlib") == read("tail") == read("crc", validate_checksums=False) == expected and read("empty") == []
    for name in ("cut", "head", "crc"):
        with pytest.raises(Exception, match="record"):
            read(name)
    with pytest.raises(Unsupported):
        read("ok", compression="lz4")


def test_arrow(spark, tmp_path):
    table = pa.table({"i": pa.array([1, 2, None], pa.uint8()), "d": pa.array(["x", "y", "x"]).dictionary_encode(), "h": pa.array(np.array([1, 2, 3], np.float16)), "t": pa.array([1, 2, 3], pa.timestamp("ms"))})
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), table.schema) as out:
        for batch in table.to_batches(max_chunksize=2):
            out.write_batch(batch)
    df = readers.read_arrow(spark, str(tmp_path / "a.arrow"))
    assert dict(df.dtypes) == {"i": "smallint", "d": "string", "h": "float", "t": "timestamp_ntz"} and [r.d for r in df.collect()] == ["x", "y", "x"]
    for codec in ("lz4", "zstd", None):
        sinks.write_arrow(df, str(tmp_path / f"out-{codec}"), codec)
        assert sorted(map(str, readers.read_arrow(spark, str(tmp_path / f"out-{codec}"), ["i", "t"]).collect())) == sorted(map(str, df.select("i", "t").collect()))
    with pytest.raises(Unsupported):
        sinks.write_arrow(df, "x", "gzip")


def png(width, height, pixels, color=2):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    heads = {
        "gif": (b"GIF89a" + struct.pack("<HH", 5, 6), (5, 6, 3)),
        "bmp": (b"BM" + bytes(16) + struct.pack("<iiHH", 7, -8, 1, 24), (7, 8, 3)),
        "jpeg": (b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 9, 10, 3), (10, 9, 3)),
        "tiff": (b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 11, 0) + struct.pack("<HHII", 257, 4, 1, 12), (11, 12, 1)),
        "webp": (b"RIFF\0\0\0\0WEBPVP8X" + bytes(4) + b"\x10\0\0\0" + (12).to_bytes(3, "little") + (13).to_bytes(3, "little"), (13, 14, 4)),
        "png": (png(2, 1, [[255, 0, 0, 0, 0, 255]]), (2, 1, 3)),
    }
    for kind, (data, size) in heads.items():
        assert images.image_format(data[:16]) == kind and images.image_size(data, kind) == size and images.image_size(data[:12], kind) in (None, size)
    assert images.image_format(b"\xff\xd8\xff", "a.bmp") == "bmp" and images.image_format(b"x", "a.jpg") == "jpeg" and images.image_format(b"12345678", "a.txt") == "unknown"
    folder = tmp_path / "cats"
    folder.mkdir()
    (folder / "a.png").write_bytes(heads["png"][0])
    row = images.read_images(spark, str(folder), label_from_folder=True).first()
    assert (row.format, row.width, row.height, row.channels, row.label) == ("png", 2, 1, 3, "cats")
    row = images.read_images(spark, str(folder), pixels=True).first()
    assert row.image.shape == [1, 2, 3] and row.image.data == [1, 0, 0, 0, 0, 1] and row.label is None
    row = images.read_images(spark, str(folder), pixels=True, normalize=False, grayscale=True, resize=(4, 2)).first()
    assert row.image.shape == [2, 4, 1] and row.image.data == [76, 76, 29, 29] * 2
    schema = images.image_schema(True, normalize=False, resize=(4, 2))
    assert schema["image"].metadata == {"shape": [2, 4, 3]} and images.image_schema().names == ["path", "format", "width", "height", "channels", "label"]
    with pytest.raises(InvalidArgument):
        images.read_images(spark, str(folder), resize=(0, 2))


def test_timeseries(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=h), float(h), "x") for h in (0, 1, 3)]
    spark.createDataFrame(rows, "timestamp timestamp_ntz, v double, note string").drop("note").write.parquet(str(tmp_path / "p"))
    df = readers.read_timeseries(spark, str(tmp_path / "p"), frequency="h", fill_missing=True, fill_method="linear")
    assert [r.v for r in df.orderBy("timestamp").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="a step is"):
        readers.read_timeseries(spark, str(tmp_path / "p"), frequency="h", validate_frequency=True).collect()
    (tmp_path / "a.csv").write_text("ts,v\n1000,1\n2000,2\n")
    found = readers.read_timeseries(spark, str(tmp_path / "a.csv"), "csv", "ts", time_unit="ms").orderBy("ts").collect()
    assert found[0].ts == datetime.datetime(1970, 1, 1, 0, 0, 1) and found[1].v == 2.0
    for bad, error in ((lambda: readers.read_timeseries(spark, "x", "h5"), Unsupported), (lambda: readers.read_timeseries(spark, str(tmp_path / "p"), time_column="none"), InvalidArgument), (lambda: readers.read_timeseries(spark, str(tmp_path / "p"), fill_missing=True), InvalidArgument)):
        with pytest.raises(error):
            bad()
