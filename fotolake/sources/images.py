"""Image files as rows: one scan, format by expression, one Arrow crossing for what needs bytes.

What fails becomes a row with an error struct, or (mode="FAILFAST") stops the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.functions.exif import BLACK_LEVEL, EXIF, ORIENTATION, WB_LEVELS
from fotolake.functions.formats import sniff
from fotolake.operators import pixels, raw, tiff
from fotolake.sources import png

ERROR = T.StructType([T.StructField("stage", T.StringType()), T.StructField("message", T.StringType())])
IMAGE = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
        T.StructField("n_channels", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("exif", EXIF), T.StructField("error", ERROR),
    ]
)
METADATA = T.StructType([f for f in IMAGE.fields if f.name not in ("width", "height", "n_channels", "data")])
#: Decoders that a user may add, by format: bytes to (height, width, 3) RGB.
Codec = Callable[[bytes], np.ndarray]


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content, format.  Filters on the first three reach the file listing."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumn("format", sniff(F.col("content")))


def load_exif(files: DataFrame, compat: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """Metadata alone: no pixel is decoded."""
    return _map(files, METADATA, lambda kind, data: {"exif": tiff.exif(data, compat)}, mode)


def load_images(spark: SparkSession, path: str, codecs: dict[str, Codec] | None = None, require_exif: bool = True, compat: bool = False, mode: str = "PERMISSIVE", glob: str | None = None) -> DataFrame:
    """Decoded images: row-major interleaved RGB.  require_exif: a JPEG without EXIF data is an error.

    Without a codec of its own a JPEG is decoded by the JVM, in Spark's image source, and joined with its EXIF data by path.
    """
    files = scan(spark, path, glob)
    if "jpeg" in (codecs or {}):
        return decode_images(files, codecs, require_exif, compat, mode)
    jpegs = files.where("format = 'jpeg'")
    rest = decode_images(files.where("format <> 'jpeg'"), codecs, require_exif, compat, mode)
    return rest.unionByName(_jpegs(jpegs, jvm_pixels(spark, path, glob), require_exif, compat, mode))


def jvm_pixels(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path (as in scan) and image (Spark's struct) of each file; those that the JVM can't read have a negative height."""
    reader = spark.read.format("image").option("dropInvalid", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # The metadata's path is percent-encoded, the scan's is not.
    return reader.load(path).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("at"), "image")


def _same_file(path: Column) -> Column:
    """A path with one slash after its scheme, since file:/x and file:///x are the same."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def _jpegs(files: DataFrame, found: DataFrame, require_exif: bool, compat: bool, mode: str) -> DataFrame:
    """Rows of IMAGE of JPEG files: EXIF data from their bytes, pixels from the JVM."""

    def tags(kind: str, data: bytes) -> dict:
        try:
            return {"exif": tiff.exif(data, compat)}
        except tiff.BadFile:
            if require_exif:
                raise
            return {"exif": {}}

    both = _map(files, METADATA, tags, mode).join(found, _same_file(F.col("path")) == _same_file(F.col("at")), "left")
    bad = F.coalesce(F.col("image.height") <= 0, F.lit(True))
    lost = F.struct(F.lit("decode").alias("stage"), F.lit("the JPEG can't be decoded").alias("message"))
    if mode == "FAILFAST":
        lost = F.raise_error(F.concat(F.lit("the JPEG can't be decoded: "), "path")).cast(ERROR)
    both = both.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error").withField("stage", F.lit("decode"))).when(bad, lost))
    good = lambda c: F.when(F.col("error").isNull(), c)
    both = both.select(
        "path", "format", good(F.col("image.width")).alias("width"), good(F.col("image.height")).alias("height"),
        good(F.col("image.nChannels")).alias("n_channels"), good(F.col("image.data")).alias("data"), good(F.col("exif")).alias("exif"), "error",
    )
    return both.mapInArrow(_as_rgb, IMAGE)


def rgb_of(data: bytes, channels: int) -> bytes:
    """RGB of Spark's image bytes: grey, or blue-green-red with or without alpha, which is left out."""
    px = np.frombuffer(data, np.uint8).reshape(-1, channels)
    return (np.repeat(px, 3, axis=1) if channels == 1 else np.ascontiguousarray(px[:, 2::-1])).tobytes()


def _as_rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        channels, data = b.schema.get_field_index("n_channels"), b.schema.get_field_index("data")
        for i in range(b.num_rows):  # one image at a time
            one = b.slice(i, 1)
            if one.column(data)[0].is_valid:
                rgb = rgb_of(one.column(data)[0].as_py(), one.column(channels)[0].as_py())
                one = one.set_column(data, b.schema.field(data), pa.array([rgb], b.schema.field(data).type))
                one = one.set_column(channels, b.schema.field(channels), pa.array([3], pa.int32()))
            yield one


def decode_images(files: DataFrame, codecs: dict[str, Codec] | None = None, require_exif: bool = True, compat: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    codecs = dict(codecs or {})

    def one(kind: str, data: bytes) -> dict:
        try:
            tags = tiff.exif(data, compat)
        except tiff.BadFile:
            if require_exif or kind != "jpeg":
                raise
            tags = {}
        if kind == "raw":
            rgb = develop(data, tags, compat)
        elif kind in codecs:
            rgb = codecs[kind](data)
        elif kind == "png":
            rgb = png.read_png(data)
        elif kind == "pdf":
            raise tiff.BadFile("PDF support is not enabled")
        else:
            raise tiff.BadFile(f"no codec for {kind}")
        return {"width": rgb.shape[1], "height": rgb.shape[0], "n_channels": 3, "data": np.ascontiguousarray(rgb, np.uint8).tobytes(), "exif": tags}

    return _map(files, IMAGE, one, mode)


def develop(data: bytes, tags: dict[int, dict], compat: bool = False) -> np.ndarray:
    """RAW to RGB: strips, decoder, black level and white balance, demosaic, orientation."""
    info = tiff.raw_info(data, compat)
    plane = raw.decode(info.variant, tiff.strips(data, info.offsets, info.counts), info.width, info.height, info.dng, compat)
    shorts = lambda tag: (tags.get(tag) or {}).get("short") or []
    black = (shorts(BLACK_LEVEL) or [512])[0]
    levels = shorts(WB_LEVELS)
    gains = (levels[0] / 1000, levels[1] / 1000, levels[3] / 1000) if len(levels) >= 4 else (1.0, 1.0, 1.0)
    rgb = pixels.demosaic(plane, black, raw.WHITE[info.variant], gains)
    return pixels.rotate(rgb, (shorts(ORIENTATION) or [1])[0], compat)


def jvm_images(spark: SparkSession, path: str) -> DataFrame:
    """What Spark's own image source reads, as RGB; files that it can't read have nulls."""
    good = F.col("image.height") > 0
    image = jvm_pixels(spark, path).select(F.col("at").alias("path"), *(F.when(good, F.col(f"image.{c}")).alias(c) for c in ("width", "height", "nChannels", "data")))
    image = image.withColumnRenamed("nChannels", "n_channels")
    return image.mapInArrow(_as_rgb, image.schema).drop("n_channels")


def resize_images(images: DataFrame, width: int, height: int) -> DataFrame:
    """Images resampled to exactly this size; rows with errors pass through, metadata stays as it is."""
    if width <= 0 or height <= 0:
        raise ValueError("width and height must be positive")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["data"] is not None:
                    rgb = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
                    r |= {"data": pixels.resize(rgb, width, height).tobytes(), "width": width, "height": height}
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return images.mapInArrow(work, images.schema)


def _map(files: DataFrame, schema: T.StructType, one: Callable[[str, bytes], dict], mode: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one image at a time, so that a batch needs no more memory than an image
                path, kind, data = (b.column(k)[i].as_py() for k in range(3))
                row = dict.fromkeys(names) | {"path": path, "format": kind}
                try:
                    got = one(kind, data or b"")
                    if got.get("exif") is not None:
                        got["exif"] = [(k, _pairs(v)) for k, v in got["exif"].items()]
                    row |= got
                except (tiff.BadFile, raw.DecodeError, ValueError) as e:
                    if mode == "FAILFAST":
                        raise
                    row["error"] = {"stage": "decode" if "data" in names else "exif", "message": str(e)}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return files.select("path", "format", "content").mapInArrow(work, schema)


def _pairs(v: dict) -> dict:
    full = dict.fromkeys(f.name for f in EXIF.valueType.fields) | v
    for k in ("rational", "srational"):
        if full[k] is not None:
            full[k] = [{"num": a, "den": b} for a, b in full[k]]
    return full
