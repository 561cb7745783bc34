"""Framed record files: length (8 bytes), masked CRC-32C of it, data, masked CRC-32C of the data, all little-endian."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomwork.errors import FormatError, Unsupported
from loomwork.functions.checksum import crc32c_of_all, masked
from loomwork.session import ship

HEADER, FOOTER = 12, 4
#: Bytes of records that are checked and passed on at once.
BATCH_BYTES = 8 << 20


def framed(records: list[bytes]) -> bytes:
    """Records as the bytes of a file."""
    lengths = [struct.pack("<Q", len(r)) for r in records]
    head, body = masked(crc32c_of_all(lengths)), masked(crc32c_of_all(records))
    return b"".join(n + struct.pack("<I", h) + r + struct.pack("<I", b) for n, h, r, b in zip(lengths, np.atleast_1d(head).tolist(), records, np.atleast_1d(body).tolist(), strict=True))


def parse(content: bytes, validate: bool = True) -> Iterator[tuple[list[bytes], list[int]]]:
    """Batches of (records, offsets). A cut length at the end ends the file; anything else that is cut is an error."""
    at, end = 0, len(content)
    while at + HEADER - 4 <= end:
        records, offsets, lengths, checks, size = [], [], [], [], 0
        while at + HEADER - 4 <= end and size < BATCH_BYTES:
            if at + HEADER > end:
                raise FormatError(f"a record's head is cut at {at}")
            length, check = struct.unpack_from("<QI", content, at)
            if at + HEADER + length + FOOTER > end:
                raise FormatError(f"the record at {at} is cut")
            lengths.append(content[at : at + 8])
            records.append(content[at + HEADER : at + HEADER + length])
            checks.append((check, struct.unpack_from("<I", content, at + HEADER + length)[0]))
            offsets.append(at)
            at += HEADER + length + FOOTER
            size += length
        if validate and records:
            found = np.stack([np.atleast_1d(masked(crc32c_of_all(lengths))), np.atleast_1d(masked(crc32c_of_all(records)))], axis=1)
            if (wrong := np.flatnonzero((found != np.array(checks, np.uint64)).any(axis=1))).size:
                raise FormatError(f"the record at {offsets[wrong[0]]} has another checksum")
        yield records, offsets


def inflated(content: bytes, compression: str | None) -> bytes:
    if compression is None:
        return content
    if compression == "gzip":
        return gzip.decompress(content)
    if compression == "zlib":
        return zlib.decompress(content)
    raise Unsupported(f"compression {compression}")


def read_tfrecords(spark: SparkSession, paths: str | list[str], validate_checksums: bool = True, compression: str | None = None) -> DataFrame:
    """(data, offset, length) of each record. A file is read by one task and must be under 2 GB."""
    ship(spark)
    inflated(b"", None)
    if compression not in (None, "gzip", "zlib"):
        raise Unsupported(f"compression {compression}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for records, offsets in parse(inflated(content.as_py(), compression), validate_checksums):
                    lengths = pa.array([len(r) for r in records], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(offsets, pa.int64()), lengths], ["data", "offset", "length"])

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInArrow(rows, "data binary, offset bigint, length int")
