"""Queries over the driver's tables: each image operator that SQL can express, and its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolake.functions import exif, formats
from fotolake.operators import pixels, raw
from fotolake.plans import bridge as b
from fotolake.plans.registry import query

# Names of some common tags.
NAMES = {
    256: "ImageWidth", 257: "ImageHeight", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 271: "Make", 272: "Model",
    274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "ModifyDate",
}


# ---- formats and headers ----


@query(f"WITH {b.BLOB_SQL} SELECT doc_id, {b.SNIFF_SQL} AS format FROM blob")
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.blobs(spark, sf_dir).select("doc_id", formats.sniff(F.col("content")).alias("format"))


@query(f"WITH {b.BLOB_SQL} SELECT {b.SNIFF_SQL} AS format, count(*) AS n FROM blob GROUP BY 1")
def format_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniff_format(spark, sf_dir).groupBy("format").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size * 37 AS BIGINT) END AS width, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey AS BIGINT) END AS height FROM part")
def png_ihdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    start = F.when(F.col("p_partkey") % 7 > 0, "89504E47").otherwise("00504E47")
    head = F.unhex(F.concat(start, F.lit("0D0A1A0A0000000D49484452"), number(F.col("p_size") * 37), number(F.col("p_partkey"))))
    size = formats.png_size(head)
    return b.table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, y, x, CAST(dn AS BIGINT) AS little, CAST((dn % 256) * 256 + dn // 256 AS BIGINT) AS big FROM mosaic")
def endian_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(formats.unsigned(F.col("data"), 2 * i, 2).alias("little"), formats.unsigned(F.col("data"), 2 * i, 2, False).alias("big")))
    rows = b.plane_bytes(spark, sf_dir).select("vec_id", F.posexplode(words).alias("i", "w"))
    return rows.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "w.little", "w.big")


@query("SELECT p_partkey, CAST((p_size % 256) * 16777216 + (p_partkey % 256) * 65536 + (p_partkey // 256 % 256) * 256 + p_size % 7 AS BIGINT) AS dng FROM part")
def dng_version_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return b.table(spark, sf_dir, "part").select("p_partkey", formats.dng_version(size % 256, key % 256, F.floor(key / 256) % 256, size % 7).alias("dng"))


# ---- RAW directories ----

FIELDS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 50 + 1 END AS width, CASE WHEN o_orderkey % 13 > 0 THEN 10 END AS height,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2 * 32766 + 1 END AS compression, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 // 4 * 2 + 1 END AS samples,
  CASE WHEN o_orderkey % 4 > 0 THEN 12 END AS bits, CASE o_custkey % 3 WHEN 0 THEN 'SONY' WHEN 1 THEN 'Sony X' ELSE 'Other' END AS make FROM orders"""
_CANDIDATE = f"""strips AS (SELECT l_orderkey, count(l_partkey) AS n_offsets, count(CASE WHEN l_linenumber < 7 THEN 1 END) AS n_counts, CAST(sum(CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS BIGINT) * 5 END) AS BIGINT) AS total
  FROM lineitem GROUP BY l_orderkey), fields AS ({FIELDS_SQL}), candidate AS (
  SELECT o_orderkey, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(coalesce(compression, 1) AS BIGINT) AS compression, CAST(coalesce(bits, 14) AS BIGINT) AS bits, total, lower(make) LIKE 'sony%' AS sony
  FROM fields JOIN strips ON o_orderkey = l_orderkey WHERE width IS NOT NULL AND height IS NOT NULL AND coalesce(samples, 1) = 1 AND n_offsets = n_counts AND n_counts > 0)"""


@query(f"WITH {_CANDIDATE} SELECT * FROM candidate")
def raw_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips are summed for each file, then met by the file's other fields; defaults stand in for missing ones."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    fields = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 11 > 0, cust % 50 + 1).alias("width"), F.when(key % 13 > 0, 10).alias("height"), F.when(key % 3 > 0, key % 2 * 32766 + 1).alias("compression"),
        F.when(key % 5 > 0, F.floor(key % 5 / 4) * 2 + 1).alias("samples"), F.when(key % 4 > 0, 12).alias("bits"), F.when(cust % 3 == 0, "SONY").when(cust % 3 == 1, "Sony X").otherwise("Other").alias("make"),
    )
    whole = fields.where(F.col("width").isNotNull() & F.col("height").isNotNull() & (F.coalesce("samples", F.lit(1)) == 1))
    counted = F.col("l_linenumber") < 7
    strips = (
        b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
        .agg(F.count("l_partkey").alias("n_offsets"), F.count(F.when(counted, 1)).alias("n_counts"), F.sum(F.when(counted, F.col("l_quantity").cast("long") * 5)).alias("total"))
        .where("n_offsets = n_counts and n_counts > 0")
    )
    return whole.join(strips, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.coalesce("compression", F.lit(1)).cast("long").alias("compression"),
        F.coalesce("bits", F.lit(14)).cast("long").alias("bits"), "total", formats.is_sony(F.col("make")).alias("sony"),
    )


@query(
    f"""WITH {_CANDIDATE}, d AS (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 1 END AS dng, CASE o_orderkey % 3 WHEN 0 THEN total WHEN 1 THEN width * height ELSE 2 * width * height END AS bytes FROM candidate)
  SELECT o_orderkey, CASE WHEN compression = 32767 THEN CASE WHEN dng IS NULL AND bytes = width * height THEN 'arw2' WHEN dng IS NULL AND sony AND bytes = 2 * width * height THEN 'uncompressed14'
  WHEN bytes * 8 <> width * height * bits THEN 'arw_ljpeg' ELSE 'unknown' END WHEN compression IN (0, 1) AND dng IS NULL AND sony AND bytes = 2 * width * height THEN 'uncompressed14' ELSE 'unknown' END AS variant FROM d"""
)
def arw_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, px = F.col("o_orderkey"), F.col("width") * F.col("height")
    total = F.when(key % 3 == 0, F.col("total")).when(key % 3 == 1, px).otherwise(2 * px)
    variant = formats.raw_variant(F.col("compression"), F.col("width"), F.col("height"), F.col("bits"), total, F.when(key % 17 == 0, 1), F.col("sony"))
    return raw_candidate(spark, sf_dir).select("o_orderkey", variant.alias("variant"))


@query(
    """SELECT file, bytes, l_linenumber, l_partkey, l_suppkey FROM (SELECT l_orderkey AS file, CAST(floor(l_quantity) AS BIGINT) // 10 AS bytes, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(floor(l_quantity) AS BIGINT) // 10 DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1 AND bytes > 0"""
)
def raw_choose_ifd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory with the most bytes, the first visited among equals: one partial aggregation."""
    bytes_ = F.expr("cast(floor(l_quantity) as bigint) div 10")
    rows = b.table(spark, sf_dir, "lineitem").withColumn("bytes", bytes_).where("bytes > 0")
    order = F.struct((-F.col("bytes")).alias("o"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.groupBy(F.col("l_orderkey").alias("file")).agg(F.min_by(F.struct("bytes", "l_linenumber", "l_partkey", "l_suppkey"), order).alias("v")).select("file", "v.*")


@query(
    """WITH RECURSIVE edge AS (SELECT n_nationkey AS a, (n_nationkey + 7) % 25 AS b FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT n_nationkey, n_nationkey * 2 % 25 FROM nation),
  walk AS (SELECT 0 AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN edge ON a = node WHERE depth < 25)
  SELECT CAST(node AS INTEGER) AS node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node
  UNION ALL SELECT CAST(r_regionkey + 100 AS INTEGER), 0 FROM region WHERE r_regionkey = 0"""
)
def ifd_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that can be reached, and in how many steps: the frontier moves on until it finds nothing new."""
    n = F.col("n_nationkey")
    nation = b.table(spark, sf_dir, "nation")
    edges = nation.where(n % 3 > 0).select(n.alias("a"), ((n + 7) % 25).alias("b")).unionByName(nation.select(n.alias("a"), (n * 2 % 25).alias("b")))
    roots = b.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(F.lit(0), F.col("r_regionkey") + 100)).alias("node"))
    seen = roots.select(F.col("node").cast("int").alias("node"), F.lit(0).alias("depth"))
    front, depth = seen, 0
    while True:
        depth += 1
        new = front.join(edges, F.col("node") == F.col("a")).select(F.col("b").cast("int").alias("node")).distinct()
        front = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        if spark.conf.get("spark.checkpoint.dir", None):
            front = front.checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


# ---- strips ----

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS n, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM lineitem"""
)
def strip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("l_quantity").cast("long")
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", n.alias("n"), F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias("pos"))


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def strip_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))


# ---- EXIF ----

LAST_SQL = f"""{b.ENTRY_SQL}, last AS (SELECT file, tag, section, ord, val FROM (SELECT *, row_number() OVER (PARTITION BY file, tag ORDER BY {b.RANK_SQL} DESC, ord DESC) AS rn FROM entry) WHERE rn = 1)"""


@query(f"WITH {LAST_SQL} SELECT * FROM last")
def exif_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = b.entries(spark, sf_dir).withColumn("rank", exif.section_rank(F.col("section")))
    return exif.overlay(ranked, ["file", "tag"], ["rank", "ord"], ["section", "ord", "val"])


@query(f"WITH {LAST_SQL} SELECT file, val FROM last WHERE tag = 42")
def exif_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exif_overlay(spark, sf_dir).where("tag = 42").select("file", "val")


@query(
    f"WITH {b.ENTRY_SQL}, names(tag, name) AS (VALUES {', '.join(f'({t}, {n!r})' for t, n in NAMES.items())}) SELECT file, ord, CAST(e.tag + 250 AS INTEGER) AS tag, name FROM entry e LEFT JOIN names n ON e.tag + 250 = n.tag"
)
def exif_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame(list(NAMES.items()), "tag int, name string")
    rows = b.entries(spark, sf_dir).select("file", "ord", (F.col("tag") + 250).alias("tag"))
    return exif.with_names(rows, tags).select("file", "ord", "tag", "name")


@query(
    f"""WITH {b.ENTRY_SQL} SELECT ord, rpad('Tag' || CAST(tag AS VARCHAR), 30, ' ') || ': ' || CASE ord % 4 WHEN 0 THEN 'text ' || CAST(val AS VARCHAR) WHEN 1 THEN CAST(val AS VARCHAR) || '/' || CAST(tag AS VARCHAR)
  WHEN 2 THEN CAST(val AS VARCHAR) || '/' || CAST(tag AS VARCHAR) || ' (signed)' ELSE CAST(tag AS VARCHAR) END AS line FROM entry"""
)
def exif_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, pair = F.col("ord") % 4, F.array(F.struct(F.col("val").alias("num"), F.col("tag").cast("long").alias("den")))
    value = F.struct(
        F.when(kind == 0, F.concat(F.lit("text "), F.col("val").cast("string"))).alias("ascii"), F.when(kind == 1, pair).alias("rational"), F.when(kind == 2, pair).alias("srational"),
        F.when(kind == 3, F.array("tag")).alias("short"), F.lit(None).cast("array<bigint>").alias("long"), F.lit(None).cast("binary").alias("bytes"),
    )
    return b.entries(spark, sf_dir).select("ord", exif.display(F.concat(F.lit("Tag"), F.col("tag").cast("string")), value).alias("line"))


@query(f"WITH {b.ENTRY_SQL} SELECT ord, CAST(CASE tag % 14 " + " ".join(f"WHEN {k} THEN {v}" for k, v in exif.SIZES.items()) + " END AS INTEGER) AS size FROM entry")
def exif_type_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.entries(spark, sf_dir).select("ord", exif.type_size(F.col("tag") % 14).alias("size"))


@query(
    f"""WITH {LAST_SQL} SELECT file, CAST(coalesce(max(CASE WHEN tag = 10 THEN val % 1000 END), 512) AS BIGINT) AS black,
  CASE WHEN count(CASE WHEN tag = 20 THEN 1 END) > 0 THEN max(CASE WHEN tag = 20 THEN val END) / 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS red FROM last GROUP BY file"""
)
def wb_black_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black level and red gain of each file; files without them get the defaults."""
    value = lambda x: F.struct(F.array(x, x, x, x).alias("short"))
    pick = lambda tag, v: F.max(F.when(F.col("tag") == tag, v))
    files = exif_overlay(spark, sf_dir).groupBy("file").agg(pick(10, F.col("val") % 1000).alias("b"), pick(20, F.col("val")).alias("w"))
    tags = F.map_from_arrays(F.array(F.lit(exif.BLACK_LEVEL), F.lit(exif.WB_LEVELS)), F.array(F.when(F.col("b").isNotNull(), value(F.col("b"))), F.when(F.col("w").isNotNull(), value(F.col("w")))))
    return files.select("file", exif.black_level(tags).cast("long").alias("black"), exif.white_balance(tags)[0].alias("red"))


# ---- sensor data ----


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, y, x, dn FROM mosaic")
def uncompressed14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(b.plane_bytes(spark, sf_dir), lambda data: raw.uncompressed14(data, 8, 8))


def decoded(rows: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """vec_id, y, x, dn of each plane: one Arrow crossing, whole batches out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [decode(x.as_py()) for x in batch.column(1)]
            if not planes:
                continue
            h, w = planes[0].shape
            y, x = np.mgrid[:h, :w].astype(np.int32)
            n = len(planes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), h * w)), pa.array(np.tile(y.ravel(), n)), pa.array(np.tile(x.ravel(), n)), pa.array(np.concatenate([p.ravel() for p in planes]).astype(np.int32))],
                ["vec_id", "y", "x", "dn"],
            )

    return rows.mapInArrow(work, "vec_id long, y int, x int, dn int")


def _block(plane: list[int]) -> bytes:
    """A block of 16 samples made of a plane's first values."""
    top, low, at_top, at_low = plane[0] % 2048, plane[1] % 2048, plane[2] % 16, plane[3] % 16
    at_low = (at_top + 1) % 16 if at_low == at_top else at_low
    whole = top | low << 11 | at_top << 22 | at_low << 26
    for k in range(14):
        whole |= plane[4 + k] % 128 << 30 + 7 * k
    return whole.to_bytes(16, "little")


@query(
    f"""WITH {b.MOSAIC_SQL}, h AS (SELECT vec_id, list(dn ORDER BY i) AS p FROM mosaic GROUP BY vec_id), f AS (SELECT vec_id, p, p[1] % 2048 AS top, p[2] % 2048 AS low, p[3] % 16 AS a,
  CASE WHEN p[4] % 16 = p[3] % 16 THEN (p[3] % 16 + 1) % 16 ELSE p[4] % 16 END AS z FROM h),
  s AS (SELECT *, CASE WHEN 128 > top - low THEN 0 WHEN 256 > top - low THEN 1 WHEN 512 > top - low THEN 2 WHEN 1024 > top - low THEN 3 ELSE 4 END AS sh, unnest(range(16)) AS x FROM f)
  SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(CASE WHEN x = a THEN top WHEN x = z THEN low ELSE (p[5 + x - CASE WHEN x > a THEN 1 ELSE 0 END - CASE WHEN x > z THEN 1 ELSE 0 END] % 128) * (1 << sh) + low END AS INTEGER) AS dn FROM s"""
)
def arw2_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_block(p) for p in batch.column(1).to_pylist()], pa.binary())], ["vec_id", "data"])

    rows = b.planes(spark, sf_dir).mapInArrow(work, "vec_id long, data binary")
    return decoded(rows, lambda data: raw.arw2(data, 16, 1)).select("vec_id", "x", "dn")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN n = 0 THEN 0 WHEN v & (1 << (n - 1)) = 0 THEN v - ((1 << n) - 1) ELSE v END AS diff FROM
  (SELECT *, CAST(l_linenumber - 1 AS INTEGER) AS n, CAST(l_quantity AS BIGINT) & ((CAST(1 AS BIGINT) << (l_linenumber - 1)) - 1) AS v FROM lineitem)"""
)
def ljpeg_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") - 1
    bits = F.col("l_quantity").cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", formats.ljpeg_difference(bits, n, F.lit(None).cast("long")).alias("diff"))


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, i, CAST(sum(dn % 64 - 20) OVER (PARTITION BY vec_id ORDER BY i) AS BIGINT) AS acc FROM mosaic")
def ljpeg_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.mosaic(spark, sf_dir).withColumn("i", F.col("y") * 8 + F.col("x"))
    upto = Window.partitionBy("vec_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("vec_id", "i", F.sum(F.col("dn") % 64 - 20).over(upto).alias("acc"))


# ---- pixels ----

_GAIN = f"CASE WHEN {{y}} % 2 = 0 AND {{x}} % 2 = 0 THEN {b.GAINS[0]} WHEN {{y}} % 2 = 1 AND {{x}} % 2 = 1 THEN {b.GAINS[2]} ELSE {b.GAINS[1]} END"


def _v(dy: int, dx: int) -> str:
    y, x = f"least(greatest(y + ({dy}), 0), 7)", f"least(greatest(x + ({dx}), 0), 7)"
    return f"(greatest(p[{y} * 8 + {x} + 1] - {b.BLACK}, 0) * ({_GAIN.format(y=y, x=x)}))"


def _tone(v: str) -> str:
    return f"CAST(floor(pow(least(greatest({v}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(1 AS DOUBLE) / CAST(2.2 AS DOUBLE)) * 255 + 0.5) AS INTEGER)"


def _demosaic_sql() -> str:
    own, flat, upright = f"4 * {_v(0, 0)}", f"2 * ({_v(0, -1)} + {_v(0, 1)})", f"2 * ({_v(-1, 0)} + {_v(1, 0)})"
    cross = f"({_v(-1, 0)} + {_v(1, 0)} + {_v(0, -1)} + {_v(0, 1)})"
    diagonal = f"({_v(-1, -1)} + {_v(-1, 1)} + {_v(1, -1)} + {_v(1, 1)})"
    red, blue = "y % 2 = 0 AND x % 2 = 0", "y % 2 = 1 AND x % 2 = 1"
    r = f"CASE WHEN {red} THEN {own} WHEN {blue} THEN {diagonal} WHEN y % 2 = 0 THEN {flat} ELSE {upright} END"
    bl = f"CASE WHEN {blue} THEN {own} WHEN {red} THEN {diagonal} WHEN y % 2 = 0 THEN {upright} ELSE {flat} END"
    g = f"CASE WHEN ({red}) OR ({blue}) THEN {cross} ELSE {own} END"
    full = float(4 * b.OVER * (b.WHITE - b.BLACK))
    parts = ", ".join(f"{_tone(f'CAST({c} AS DOUBLE) / {full}::DOUBLE')} AS {n}" for c, n in ((r, "r"), (g, "g"), (bl, "b")))
    return f"rgb AS (SELECT vec_id, y, x, {parts} FROM (SELECT m.vec_id, y, x, p FROM mosaic m JOIN (SELECT vec_id, list(dn ORDER BY i) AS p FROM mosaic GROUP BY vec_id) l ON m.vec_id = l.vec_id))"


RGB_SQL = f"{b.MOSAIC_SQL}, {_demosaic_sql()}"


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, y, x, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'R' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'B' ELSE 'G' END AS colour FROM mosaic")
def cfa_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.mosaic(spark, sf_dir).select("vec_id", "y", "x", pixels.cfa_colour(F.col("y"), F.col("x")).alias("colour"))


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, y, x, CAST(greatest(dn - {b.BLACK}, 0) * ({_GAIN.format(y='y', x='x')}) AS INTEGER) AS v FROM mosaic")
def wb_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest(F.col("dn") - b.BLACK, F.lit(0)) * pixels.gain_of(F.col("y"), F.col("x"), b.GAINS)
    return b.mosaic(spark, sf_dir).select("vec_id", "y", "x", v.alias("v"))


@query(f"WITH {RGB_SQL} SELECT * FROM rgb")
def demosaic_rgb8_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions within a row: no shuffle."""
    px = pixels.demosaic_array(F.col("plane"), 8, 8, b.BLACK, b.WHITE, b.GAINS, b.OVER)
    return b.planes(spark, sf_dir).select("vec_id", F.inline(px))


def _rgb_rows(rows: DataFrame, turn: bool) -> DataFrame:
    gains = tuple(g / b.OVER for g in b.GAINS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            planes = [raw.uncompressed14(x.as_py(), 8, 8) for x in batch.column(1)]
            rgb = np.stack([pixels.rotate(pixels.demosaic(p, b.BLACK, b.WHITE, gains), int(i) % 8 + 1 if turn else 1) for i, p in zip(ids, planes, strict=True)])
            y, x = np.mgrid[:8, :8].astype(np.int32)
            flat = rgb.reshape(-1, 3).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, 64)), pa.array(np.tile(y.ravel(), len(ids))), pa.array(np.tile(x.ravel(), len(ids))), *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3))],
                ["vec_id", "y", "x", "r", "g", "b"],
            )

    return rows.mapInArrow(work, "vec_id long, y int, x int, r int, g int, b int")


@query(f"WITH {RGB_SQL} SELECT * FROM rgb")
def demosaic_rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel for whole images, over the same planes."""
    return _rgb_rows(b.plane_bytes(spark, sf_dir), False)


TURN_Y = "CASE vec_id % 8 + 1 WHEN 8 THEN 7 - x WHEN 6 THEN x ELSE y END"
TURN_X = "CASE vec_id % 8 + 1 WHEN 8 THEN y WHEN 6 THEN 7 - y ELSE x END"


@query(f"WITH {RGB_SQL} SELECT vec_id, CAST({TURN_Y} AS INTEGER) AS y, CAST({TURN_X} AS INTEGER) AS x, r, g, b FROM rgb")
def image_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to samples to RGB to upright pictures."""
    return _rgb_rows(b.plane_bytes(spark, sf_dir), True)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_tone('l_discount * 5 + l_tax')} AS level FROM lineitem")
def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = pixels.tone_value(F.col("l_discount") * 5 + F.col("l_tax"))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", level.alias("level"))


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, CAST(7 - x AS INTEGER) AS y, y AS x, dn FROM mosaic")
def rotate270(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = pixels.rotate270_index(8, 8, F.col("y"), F.col("x"))
    return b.mosaic(spark, sf_dir).select("vec_id", y.alias("y"), x.alias("x"), "dn")


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, CAST({TURN_Y} AS INTEGER) AS y, CAST({TURN_X} AS INTEGER) AS x, dn FROM mosaic")
def orientation_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, y, x = F.col("vec_id") % 8 + 1, F.col("y"), F.col("x")
    new_y = F.when(turn == 8, 7 - x).when(turn == 6, x).otherwise(y)
    new_x = F.when(turn == 8, y).when(turn == 6, 7 - y).otherwise(x)
    return b.mosaic(spark, sf_dir).select("vec_id", new_y.alias("y"), new_x.alias("x"), "dn")


def _weights(target: int) -> list[tuple[int, int, int]]:
    w = pixels.lanczos_weights(8, target, fixed=14)
    return [(t, s, int(w[t, s])) for t in range(target) for s in range(8) if w[t, s]]


def _resize_sql(target: int) -> str:
    rows = ", ".join(map(str, _weights(target)))
    return f"""WITH {b.MOSAIC_SQL}, w(t, s, k) AS (VALUES {rows}), a AS (SELECT vec_id, y, t AS tx, sum(CAST(dn AS BIGINT) * k) AS v FROM mosaic JOIN w ON x = s GROUP BY ALL)
  SELECT vec_id, CAST(t AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, CAST(least(greatest((sum(v * k) + 134217728) // 268435456, 0), 65535) AS BIGINT) AS dn FROM a JOIN w ON y = s GROUP BY vec_id, t, tx"""


def _resized(spark: SparkSession, sf_dir: str, target: int) -> DataFrame:
    """Both passes within a row: weights are literals, so nothing is shuffled."""
    w = [[int(v) for v in row] for row in pixels.lanczos_weights(8, target, fixed=14)]
    flat = F.array(*[F.lit(v).cast("long") for row in w for v in row])
    dot = lambda t, get: sum((F.get(F.col("w"), t * 8 + s) * get(s) for s in range(1, 8)), F.get(F.col("w"), t * 8) * get(0))
    plane = F.col("plane")
    wide = F.transform(F.sequence(F.lit(0), F.lit(8 * target - 1)), lambda i: dot(i % target, lambda s: F.get(plane, F.floor(i / target).cast("int") * 8 + s)))
    high = F.transform(F.sequence(F.lit(0), F.lit(target * target - 1)), lambda i: dot(F.floor(i / target).cast("int"), lambda s: F.get(F.col("wide"), i % target + s * target)))
    rows = b.planes(spark, sf_dir).withColumn("w", flat).withColumn("wide", wide).select("vec_id", F.posexplode(high).alias("i", "v"))
    value = F.floor((F.col("v") + 134217728) / 268435456.0).cast("long")
    return rows.select("vec_id", F.floor(F.col("i") / target).cast("int").alias("y"), (F.col("i") % target).alias("x"), F.least(F.greatest(value, F.lit(0)), F.lit(65535)).cast("long").alias("dn"))


@query(_resize_sql(4))
def resize_lanczos3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, 4)


@query(_resize_sql(16))
def resize_lanczos3_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, 16)
