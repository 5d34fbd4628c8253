"""Views that turn the driver's tables into mosaics, headers and directory entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
BLACK, WHITE = 512, 16383
#: White balance (1.5, 1, 2) over two, so that sums stay whole numbers.
GAINS, OVER = (3, 2, 4), 2
#: Leading bytes by doc_id modulo 8; the last lets the text speak.
HEADS = ("FFD8", "8950", "5249", "2550", "4949", "4D4D", "0000", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, plane: 8 x 8 samples as an array of integers."""
    dn = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 8192).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", dn.alias("plane"))


def plane_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, data: the samples as little-endian 16-bit words."""
    word = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    return planes(spark, sf_dir).select("vec_id", F.unhex(F.array_join(F.transform("plane", word), "")).alias("data"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, x, dn."""
    px = planes(spark, sf_dir).select("vec_id", F.posexplode("plane").alias("i", "dn"))
    return px.select("vec_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), "dn")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(head), body).alias("content"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, section, ord, tag, val."""
    kind = F.col("event_type")
    section = F.when(kind == "view", "ifd0").when(kind == "click", "exif").otherwise("sub")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), section.alias("section"), F.col("event_id").alias("ord"),
        F.get_json_object("props", "$.k").cast("int").alias("tag"), F.floor(F.col("value") * 100).cast("long").alias("val"),
    )


# ---- the same in SQL ----

MOSAIC_SQL = f"""mosaic AS (
  SELECT vec_id, CAST(i // {SIDE} AS INTEGER) AS y, CAST(i % {SIDE} AS INTEGER) AS x, CAST(i AS INTEGER) AS i,
         CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 8192) AS INTEGER) AS dn
  FROM (SELECT vec_id, embedding, unnest(range({SIDE * SIDE})) AS i FROM embeddings))"""
ENTRY_SQL = """entry AS (
  SELECT user_id AS file, CASE event_type WHEN 'view' THEN 'ifd0' WHEN 'click' THEN 'exif' ELSE 'sub' END AS section,
         event_id AS ord, CAST(json_extract_string(props, '$.k') AS INTEGER) AS tag, CAST(floor(value * 100) AS BIGINT) AS val
  FROM events)"""
RANK_SQL = "CASE section WHEN 'ifd0' THEN 0 WHEN 'exif' THEN 1 ELSE 2 END"
BLOB_SQL = (
    "blob AS (SELECT doc_id, CASE doc_id % 8 "
    + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HEADS))
    + " END || hex(encode(coalesce(text, ''))) AS h FROM documents)"
)
SNIFF_SQL = (
    "CASE WHEN length(h) < 4 THEN 'io_error' WHEN h LIKE 'FFD8%' THEN 'jpeg' WHEN h LIKE '8950%' THEN 'png' WHEN h LIKE '5249%' THEN 'webp' "
    "WHEN h LIKE '2550%' THEN 'pdf' WHEN h LIKE '4949%' OR h LIKE '4D4D%' THEN 'raw' ELSE 'unsupported' END"
)
