"""File formats by name and by first bytes, as driver functions and as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import ship

#: Formats by file extension.
EXTENSIONS = {
    "csv": "csv",
    "tsv": "csv",
    "parquet": "parquet",
    "json": "json",
    "jsonl": "jsonl",
    "ndjson": "jsonl",
    "avro": "avro",
    "tfrecord": "tfrecord",
    "arrow": "arrow",
    "arrows": "arrow",
    "ipc": "arrow",
    "jpg": "image",
    "jpeg": "image",
    "png": "image",
    "gif": "image",
    "bmp": "image",
    "tiff": "image",
    "tif": "image",
    "webp": "image",
}
#: Formats of compressed files by the extension before .gz; any other is plain gz.
COMPRESSED = {"csv": "csv.gz", "tsv": "csv.gz", "json": "json.gz", "parquet": "parquet.gz"}
GZIP = ("gz", "gzip")
HEAD = 32


def format_of_path(path: str) -> str | None:
    """The format that a name promises; None if its extension is unknown or missing."""
    parts = path.rsplit("/", 1)[-1].lower().split(".")
    if len(parts) < 2:
        return None
    if parts[-1] in GZIP:
        return COMPRESSED.get(parts[-2], "gz") if len(parts) > 2 else "gz"
    return EXTENSIONS.get(parts[-1])


def format_of_bytes(head: bytes, path: str | None = None) -> str:
    """By name first, then by the first bytes; ``binary`` if nothing else fits."""
    if path and (named := format_of_path(path)):
        return named
    if len(head) >= 4:
        if head.startswith(b"PAR1"):
            return "parquet"
        if head.startswith(b"ARROW1"):
            return "arrow"
        if head.startswith(b"\x1f\x8b"):
            return "gz"
        if head[:1] in (b"{", b"["):
            return "json"
        if b"," in head[:HEAD]:
            return "csv"
    return "binary"


def path_format(path: Column) -> Column:
    """format_of_path() as an expression."""
    parts = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.")
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    inner = F.when(F.size(parts) > 2, F.element_at(parts, F.when(F.size(parts) > 2, -2).otherwise(-1)))

    def chosen(key: Column, table: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for value in dict.fromkeys(table.values()):
            out = F.when(key.isin([k for k, v in table.items() if v == value]), value).otherwise(out)
        return out

    return F.when(last.isin(*GZIP), F.coalesce(chosen(inner, COMPRESSED), F.lit("gz"))).otherwise(chosen(last, EXTENSIONS))


def head_of(path: str) -> bytes:
    """The first bytes of a file, on whatever file system its name says."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as file:
        return file.read(HEAD)


def detect_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, format) of files, from their names or else their first bytes: only those are read."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", path_format(F.col("path")).alias("format"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [named or format_of_bytes(head_of(path)) for path, named in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "format"])

    return files.mapInArrow(opened, "path string, format string")
