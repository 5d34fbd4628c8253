"""Helpers that all training-data operators share: column picking and shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import json
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_CACHES: dict[str, dict] = {}


def own_caches(owner: str) -> dict:
    """A Python worker's table for one owner.  Workers outlive stages, so asking for one drops all others."""
    if owner not in _CACHES:
        for other in _CACHES.values():
            other.clear()
        _CACHES.clear()
        _CACHES[owner] = {}
        pa.default_memory_pool().release_unused()
        trim()
    return _CACHES[owner]


def trim() -> None:
    """Give memory that is free again back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name and position.

    Extra columns never clash, not even when their names differ from a wanted one by case alone.
    """
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local folder serves in local mode only; a cluster must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _ROOTS:
        _ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
    return _ROOTS[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch
        pass


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows made on the driver, as a plan without any Python worker.  schema: as in "a string, b array<int>"."""
    kinds = ",".join(x.strip().replace(" ", ":", 1) for x in re.split(r",\s*(?![^<]*>)", schema))
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{kinds}>>'))", args={"rows": json.dumps(rows)})


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, removed when the driver exits."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a table in the shared scratch folder and read it back: lineage ends there.

    A lost executor costs its running tasks only, and a plan that reads the result twice
    does not compute it twice.  The folder is removed when the driver exits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing will read again."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _remove(df.sparkSession, f)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
