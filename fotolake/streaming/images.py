"""Image files as a stream: new files of a folder become rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions.formats import sniff

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The binary file source needs its schema given when it streams."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn("format", sniff(F.col("content")))


def format_counts(files: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files of each format by time of change; windows close when the watermark has passed them."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "format").count()
