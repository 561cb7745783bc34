"""Sinks: writers of files and collectors with a bound."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomwork.errors import InvalidArgument, Unsupported

CODECS = ("uncompressed", "snappy", "gzip", "lz4", "zstd")


def collect_rows(df: DataFrame, order: list[str] | None = None, most: int | None = None) -> list:
    """Rows in the driver: with a bound the first ones, of ``order`` if given; the rest is not read on."""
    df = df.orderBy(*order) if order else df
    return (df.limit(most) if most is not None else df).collect()


def collect_arrow(df: DataFrame, most: int | None = None) -> pa.Table:
    return (df.limit(most) if most is not None else df).toArrow()


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', quote_all: bool = False, single: bool = False, mode: str = "errorifexists") -> None:
    """CSV files in a folder; ``single`` leaves one file, written by one task."""
    out = df.coalesce(1) if single else df
    out.write.mode(mode).csv(path, header=header, sep=delimiter, quote=quote, escape=quote, quoteAll=quote_all, nullValue="", emptyValue="")


def write_parquet(
    df: DataFrame,
    path: str,
    compression: str = "snappy",
    row_group_bytes: int | None = None,
    dictionary: bool = True,
    dictionary_page_bytes: int = 1 << 20,
    page_bytes: int = 1 << 20,
    bloom_filters: list[str] | None = None,
    bloom_fpp: float = 0.05,
    partition_by: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Parquet files in a folder."""
    if compression not in CODECS:
        raise Unsupported(f"codec {compression}; there are {', '.join(CODECS)}")
    options = {"compression": compression, "parquet.enable.dictionary": str(dictionary).lower(), "parquet.dictionary.page.size": dictionary_page_bytes, "parquet.page.size": page_bytes}
    if row_group_bytes:
        options["parquet.block.size"] = row_group_bytes
    for column in bloom_filters or []:
        if column not in df.columns:
            raise InvalidArgument(f"no column {column}")
        options |= {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.fpp#{column}": str(bloom_fpp)}
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


@dataclass
class Written(WriterCommitMessage):
    """One task's file, under its temporary and its final name."""

    temporary: str
    final: str


class ArrowFiles(DataSourceArrowWriter):
    """One Arrow IPC file a task, renamed when all tasks are done."""

    def __init__(self, path: str, compression: str | None):
        self.path, self.compression = path, compression

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        name = f"part-{uuid.uuid4().hex}.arrow"
        system.create_dir(root, recursive=True)
        temporary = os.path.join(root, f"_temporary-{name}")
        writer = None
        with system.open_output_stream(temporary) as out:
            for batch in iterator:
                writer = writer or pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=self.compression))
                writer.write_batch(batch)
            if writer:
                writer.close()
        if writer is None:
            system.delete_file(temporary)
            return Written("", "")
        return Written(temporary, os.path.join(root, name))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.temporary:
                self._system().move(m.temporary, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.temporary:
                self._system().delete_file(m.temporary)


class ArrowSink(DataSource):
    """Format ``loomwork_arrow`` for df.write."""

    @classmethod
    def name(cls) -> str:
        return "loomwork_arrow"

    def writer(self, schema, overwrite: bool) -> ArrowFiles:
        compression = self.options.get("compression", "lz4")
        return ArrowFiles(self.options["path"], None if compression == "none" else compression)


def write_arrow(df: DataFrame, path: str, compression: str | None = "lz4") -> None:
    """Arrow IPC files in a folder that all executors share."""
    if compression not in (None, "lz4", "zstd"):
        raise Unsupported(f"compression {compression}")
    df.sparkSession.dataSource.register(ArrowSink)
    df.write.format("loomwork_arrow").mode("append").option("compression", compression or "none").save(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a database whose JDBC driver is on the class path."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()
