"""spark-submit entry: ``python -m fotolake exif PATH`` or ``python -m fotolake convert PATH FOLDER [WIDTH HEIGHT]``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fotolake.functions.exif import to_json
from fotolake.shipping import ship
from fotolake.sources.images import load_exif, load_images, resize_images, scan
from fotolake.sources.sinks import write_images


def main(args: list[str]) -> int:
    if not (args[:1] == ["exif"] and len(args) == 2) and not (args[:1] == ["convert"] and len(args) in (3, 5)):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("fotolake").getOrCreate()
    ship(spark)
    if args[0] == "exif":
        rows = load_exif(scan(spark, args[1])).select("path", "format", to_json(F.col("exif")).alias("exif"), "error.message")
        for r in rows.toLocalIterator():
            print(r.path, r.format, r.exif if r.message is None else f"error: {r.message}", sep="\t")
        return 0
    images = load_images(spark, args[1])
    if len(args) == 5:
        images = resize_images(images, int(args[3]), int(args[4]))
    for r in write_images(images, args[2]).toLocalIterator():
        print(r.path, r.target, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
