"""Images: formats by first bytes, sizes from headers, and pixels as tensors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.errors import InvalidArgument
from loomwork.session import ship
from loomwork.sources.detect import EXTENSIONS

TARGET = 224
#: Weights of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)


def image_format(head: bytes, path: str = "") -> str:
    """``jpeg``, ``png``, ``gif``, ``bmp``, ``tiff``, ``webp`` or ``unknown``; by name if the bytes don't tell."""
    if len(head) >= 8:
        if head[:3] == b"\xff\xd8\xff":
            return "jpeg"
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return "png"
        if head[:4] == b"GIF8":
            return "gif"
        if head[:2] == b"BM":
            return "bmp"
        if head[:4] in (b"II*\x00", b"MM\x00*"):
            return "tiff"
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return "webp"
    extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if EXTENSIONS.get(extension) == "image":
        return {"jpg": "jpeg", "tif": "tiff"}.get(extension, extension)
    return "unknown"


def image_size(data: bytes, kind: str) -> tuple[int, int, int] | None:
    """(width, height, channels) from the header; None if it is cut or of no known kind."""
    try:
        if kind == "png":
            width, height, _, color = struct.unpack_from(">IIBB", data, 16)
            return width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[color]
        if kind == "gif":
            return *struct.unpack_from("<HH", data, 6), 3
        if kind == "bmp":
            width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
            return width, abs(height), {8: 1, 24: 3, 32: 4}.get(bits, 3)
        if kind == "jpeg":
            at = 2
            while True:
                marker, length = struct.unpack_from(">HH", data, at)
                if 0xFFC0 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
                    height, width, channels = struct.unpack_from(">HHB", data, at + 5)
                    return width, height, channels
                at += 2 + length
        if kind == "tiff":
            order = "<" if data[:2] == b"II" else ">"
            at = struct.unpack_from(order + "I", data, 4)[0]
            tags = {}
            for i in range(struct.unpack_from(order + "H", data, at)[0]):
                tag, type_, _, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
                tags[tag] = struct.unpack_from(order + ("H" if type_ == 3 else "I"), data, at + 10 + 12 * i)[0]
            return tags[256], tags[257], tags.get(277, 1)
        if kind == "webp":
            if data[12:16] == b"VP8X":
                width, height = (int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27))
                return width, height, 4 if data[20] & 0x10 else 3
            if data[12:16] == b"VP8L":
                bits = struct.unpack_from("<I", data, 21)[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3
            width, height = struct.unpack_from("<HH", data, 26)
            return width & 0x3FFF, height & 0x3FFF, 3
    except (struct.error, KeyError, IndexError):
        pass
    return None


def image_schema(pixels: bool = False, normalize: bool = True, grayscale: bool = False, resize: tuple[int, int] | None = None) -> T.StructType:
    """path, format, width, height, channels, on demand the image tensor (its static shape in metadata), and label."""
    fields = [T.StructField("path", T.StringType(), False), T.StructField("format", T.StringType(), False)]
    fields += [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.ByteType())]
    if pixels:
        value = T.FloatType() if normalize else T.ShortType()
        height, width = (resize[1], resize[0]) if resize else (0, 0)
        tensor = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(value))])
        fields.append(T.StructField("image", tensor, True, {"shape": [height, width, 1 if grayscale else 3]}))
    return T.StructType([*fields, T.StructField("label", T.StringType())])


def read_images(
    spark: SparkSession,
    paths: str | list[str],
    pixels: bool = False,
    normalize: bool = True,
    grayscale: bool = False,
    resize: tuple[int, int] | bool | None = None,
    label_from_folder: bool = False,
) -> DataFrame:
    """Image files. Without ``pixels`` only headers are parsed; with them Spark's image source decodes.

    ``resize`` is (width, height), or True for 224 by 224, by the nearest pixel; values are 0 to 1 if normalised.
    """
    ship(spark)
    if resize is True:
        resize = (TARGET, TARGET)
    if resize and min(resize) < 1:
        raise InvalidArgument("a size is positive")
    schema = image_schema(pixels, normalize, grayscale, resize or None)
    label = F.element_at(F.split("path", "/"), -2) if label_from_folder else F.lit(None).cast("string")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                kind = image_format(content[:16], path)
                width, height, channels = image_size(content, kind) or (None, None, None)
                rows.append({"path": path, "format": kind, "width": width, "height": height, "channels": channels})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int8())]))

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    known = files.mapInArrow(headers, "path string, format string, width int, height int, channels tinyint")
    if not pixels:
        return known.withColumn("label", label).select(*schema.names)

    def tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.float32() if normalize else pa.int16()
        for batch in batches:
            for path, width, height, channels, data in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "height", "channels", "data")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                image = np.repeat(image, 3, axis=2) if channels == 1 else image[:, :, 2::-1]
                if resize:
                    image = image[np.arange(resize[1]) * height // resize[1]][:, np.arange(resize[0]) * width // resize[0]]
                if grayscale:
                    image = np.rint(image @ np.array(GREY))[:, :, None]
                values = (image / 255).astype(np.float32) if normalize else image.astype(np.int16)
                tensor = {"shape": list(image.shape), "data": values.reshape(-1)}
                yield pa.RecordBatch.from_pydict({"path": [path], "image": pa.array([tensor], pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(kind))]))})

    decoded = spark.read.format("image").option("dropInvalid", True).load(paths)
    decoded = decoded.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    images = decoded.mapInArrow(tensors, T.StructType([T.StructField("path", T.StringType()), schema["image"]]))
    plain = F.regexp_replace("path", "^file:/+", "/")
    joined = known.withColumn("_at", plain).join(images.withColumn("_at", plain).drop("path"), "_at", "left")
    return joined.withColumn("label", label).select(*schema.names)
