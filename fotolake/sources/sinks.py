"""Writers of decoded images.  Parquet keeps all columns; files go through an encoder for each row."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.sources.png import write_png

Encoder = Callable[[np.ndarray], bytes]


def encode_images(images: DataFrame, kind: str = "png", encoder: Encoder | None = None) -> DataFrame:
    """path and the encoded file.  PNG is built in; other kinds (WebP among them) need an encoder."""
    if encoder is None:
        if kind != "png":
            raise ValueError(f"no encoder for {kind}: pass one")
        encoder = write_png

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rgb = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([encoder(rgb)], pa.binary())], ["path", "file"])

    return images.where(F.col("data").isNotNull()).select("path", "width", "height", "data").mapInArrow(work, "path string, file binary")


def write_images(images: DataFrame, folder: str, kind: str = "png", encoder: Encoder | None = None) -> DataFrame:
    """Write a file for each image into a folder that all executors share, and return path and target.

    A file appears under its name when it is whole, so a task that runs twice does no harm.  Names carry a
    hash of the source path, so equal base names don't clash.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            done = []
            for r in b.to_pylist():
                base = os.path.splitext(os.path.basename(r["path"]))[0]
                target = os.path.join(folder, f"{base}-{r['key']}.{kind}")
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(r["file"])
                os.replace(part, target)
                done.append(target)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done)], ["path", "target"])

    key = F.substring(F.sha2("path", 256), 1, 12).alias("key")
    return encode_images(images, kind, encoder).select("path", "file", key).mapInArrow(work, "path string, target string")
