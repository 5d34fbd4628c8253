"""Queries that go through whole files: the driver's rows become TIFF, JPEG and RAW bytes, which the loader's own code reads."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions import exif, formats
from fotolake.operators import raw, tiff
from fotolake.plans import bridge as b
from fotolake.plans.queries import FIELDS_SQL, LAST_SQL, RGB_SQL, TURN_X, TURN_Y, decoded
from fotolake.plans.registry import ORACLE_SQL, QUERIES, query
from fotolake.sources.images import decode_images, load_exif, resize_images

__all__ = ["ORACLE_SQL", "QUERIES"]
EXIF_LINK, SUB_LINK, DNG = 0x8769, 0x014A, 0xC612

# ---- writers of bytes ----


def tiff_bytes(dirs: list[tuple[list[tuple], int | None]], order: str = "<") -> bytes:
    """A TIFF structure.  dirs: entries (tag, type, values) and the number of the directory that follows, or none.

    Values of the two link tags are numbers of directories.
    """
    at, places = 8, []
    for entries, _ in dirs:
        places.append(at)
        at += 6 + 12 * len(entries)
    heap, body = b"", b""
    for entries, following in dirs:
        body += struct.pack(order + "H", len(entries))
        for tag, typ, values in entries:
            if tag in (EXIF_LINK, SUB_LINK):
                values = [places[k] for k in values]
            count, data = len(values), _packed(order, typ, values)
            body += struct.pack(order + "HHI", tag, typ, count)
            if len(data) <= 4:
                body += data.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", at + len(heap))
                heap += data
        body += struct.pack(order + "I", 0 if following is None else places[following])
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + heap


def _packed(order: str, typ: int, values) -> bytes:
    if isinstance(values, bytes):
        return values
    if typ in (5, 10):
        values = [x for pair in values for x in pair]
    code = {3: "H", 4: "I", 5: "I", 9: "i", 10: "i"}[typ]
    return struct.pack(f"{order}{len(values)}{code}", *values)


def jpeg_bytes(exif_data: bytes) -> bytes:
    """A JPEG without pixels: another segment, fill bytes, the Exif segment, the end."""
    size = struct.pack(">H", min(8 + len(exif_data), 65535))
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xff\xe1" + size + b"Exif\0\0" + exif_data + b"\xff\xd9"


def ljpeg_bytes(plane: list[int], side: int = b.SIDE, extra_rows: int = 8) -> bytes:
    """Differences of the samples (below 4096), in the decoder's order, as Huffman codes and bits."""
    bits, symbols = raw.huffman()
    codes = {symbols[c]: (bits[c], c >> 15 - bits[c]) for c in range(len(bits) - 1, -1, -1)}
    total, out, n, before = side + extra_rows, 0, 0, 0
    for col in range(side - 1, -1, -1):
        for row in (*range(0, total, 2), *range(1, total, 2)):
            v = plane[row * side + col] if row < side else before
            d, before = v - before, v
            length = abs(d).bit_length()
            width, code = codes[length]
            out = (out << width | code) << length | (d if d >= 0 else d + (1 << length) - 1)
            n += width + length
    whole = -(-n // 8)
    return (out << 8 * whole - n).to_bytes(whole, "big").replace(b"\xff", b"\xff\0")


def _mapped(rows: DataFrame, schema: str, one: Callable[[dict], dict | None]) -> DataFrame:
    """one(row) of each row; rows for which it gives nothing go."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for r in batch.to_pylist() if (x := one(r)) is not None], schema=arrow)

    return rows.mapInArrow(work, schema)


# ---- RAW directories ----


def _one_directory(r: dict) -> dict:
    """A file whose fields are there or not, as the row says."""
    key = r["key"]
    counts = r["counts"] if key % 3 == 0 else [(r["width"] or 0) * (r["height"] or 0) * (key % 3)]
    offsets = [0] * (r["n_offsets"] if key % 3 == 0 else 1)
    entries = [(256, 4, [r["width"]]), (257, 3, [r["height"]]), (258, 3, [r["bits"]]), (259, 3, [r["compression"]]), (277, 3, [r["samples"]])]
    entries = [e for e in entries if e[2][0] is not None] + [(271, 2, r["make"].encode() + b"\0")]
    entries += [(t, 4, v) for t, v in ((273, offsets), (279, counts)) if v]
    if key % 17 == 0:
        entries.append((DNG, 1, bytes((1, 4, key % 200, 0))))
    return {"key": key, "content": tiff_bytes([(entries, None)], "<>"[key % 2])}


def _info(r: dict) -> dict | None:
    try:
        i = tiff.raw_info(r["content"])
    except tiff.BadFile:
        return None
    return {
        "key": r["key"], "width": i.width, "height": i.height, "bits": i.bits, "compression": i.compression, "total": i.total,
        "sony": i.sony, "dng": i.dng, "variant": i.variant, "visited": len(i.visited),
    }


INFO = "key long, width long, height long, bits long, compression long, total long, sony boolean, dng long, variant string, visited long"


@query(
    f"""WITH strips AS (SELECT l_orderkey, count(l_partkey) AS n_offsets, count(CASE WHEN l_linenumber < 7 THEN 1 END) AS n_counts, CAST(sum(CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS BIGINT) * 5 END) AS BIGINT) AS total
  FROM lineitem GROUP BY l_orderkey), fields AS ({FIELDS_SQL}), c AS (SELECT o_orderkey AS key, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(coalesce(bits, 14) AS BIGINT) AS bits,
  CAST(coalesce(compression, 1) AS BIGINT) AS compression, CAST(CASE o_orderkey % 3 WHEN 0 THEN total ELSE width * height * (o_orderkey % 3) END AS BIGINT) AS total, lower(make) LIKE 'sony%' AS sony,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(17039360 + o_orderkey % 200 * 256 AS BIGINT) END AS dng
  FROM fields JOIN strips ON o_orderkey = l_orderkey WHERE width IS NOT NULL AND height IS NOT NULL AND coalesce(samples, 1) = 1 AND (o_orderkey % 3 > 0 OR n_offsets = n_counts AND n_counts > 0))
  SELECT *, CASE WHEN compression = 32767 THEN CASE WHEN dng IS NULL AND total = width * height THEN 'arw2' WHEN dng IS NULL AND sony AND total = 2 * width * height THEN 'uncompressed14'
  WHEN total * 8 <> width * height * bits THEN 'arw_ljpeg' ELSE 'unknown' END WHEN compression IN (0, 1) AND dng IS NULL AND sony AND total = 2 * width * height THEN 'uncompressed14' ELSE 'unknown' END AS variant FROM c"""
)
def raw_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the RAW detector says of files in both byte orders; files without a usable directory give no row."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    fields = b.table(spark, sf_dir, "orders").select(
        key.alias("key"), F.when(key % 11 > 0, cust % 50 + 1).alias("width"), F.when(key % 13 > 0, 10).alias("height"), F.when(key % 3 > 0, key % 2 * 32766 + 1).alias("compression"),
        F.when(key % 5 > 0, F.floor(key % 5 / 4) * 2 + 1).alias("samples"), F.when(key % 4 > 0, 12).alias("bits"), F.when(cust % 3 == 0, "SONY").when(cust % 3 == 1, "Sony X").otherwise("Other").alias("make"),
    )
    # A file's strips: as many as the lines of an order.
    strips = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.count("l_partkey").alias("n_offsets"), F.collect_list(F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("long") * 5)).alias("counts")
    )
    files = _mapped(fields.join(strips, "key"), "key long, content binary", _one_directory)
    return _mapped(files, INFO, _info).drop("visited")


def _many_directories(r: dict) -> dict:
    """A directory for each line: even keys in a ring, odd ones as sub-directories of an empty one."""
    own = [[(256, 4, [x["width"]]), (257, 4, [x["height"]]), (258, 3, [x["line"]]), (273, 4, [0]), (279, 4, [x["n"]])] for x in r["lines"]]
    if r["key"] % 2 == 0:
        return {"key": r["key"], "content": tiff_bytes([(e, (i + 1) % len(own)) for i, e in enumerate(own)])}
    # The last of the list is visited first.
    return {"key": r["key"], "content": tiff_bytes([([(SUB_LINK, 4, list(range(len(own), 0, -1)))], None)] + [(e, None) for e in own], ">")}


@query(
    """SELECT key, total, line, width, height, visited FROM (SELECT l_orderkey AS key, CAST(floor(l_quantity) AS BIGINT) // 10 AS total, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS width, l_suppkey AS height,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(floor(l_quantity) AS BIGINT) // 10 DESC, l_linenumber, l_partkey, l_suppkey) AS rn,
  CAST(count(*) OVER (PARTITION BY l_orderkey) + l_orderkey % 2 AS BIGINT) AS visited FROM lineitem) WHERE rn = 1 AND total > 0"""
)
def raw_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over rings and sub-directories: the directory with the most bytes, the first met among equals."""
    n = F.expr("cast(floor(l_quantity) as bigint) div 10")
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height"), n.alias("n"))
    rows = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    found = _mapped(_mapped(rows, "key long, content binary", _many_directories), INFO, _info)
    return found.select("key", "total", F.col("bits").alias("line"), "width", "height", "visited")


# ---- EXIF ----


def _exif_file(r: dict) -> dict:
    """A JPEG whose entries stand in three directories; their types go with ord."""
    parts: dict[str, list] = {s: [] for s in exif.SECTIONS}
    for x in r["entries"]:
        kind, val = x["ord"] % 4, x["val"]
        parts[x["section"]].append((x["tag"], *((4, [val]), (5, [(val, x["tag"] + 1)]), (9, [-val]), (3, [val % 65536]))[kind]))
    links = [(EXIF_LINK, 4, [1]), (SUB_LINK, 4, [2])]
    data = tiff_bytes([(parts["ifd0"] + links, None), (parts["exif"], None), (parts["sub"], None)], "<>"[r["file"] % 2])
    return {"path": str(r["file"]), "content": jpeg_bytes(data)}


@query(
    f"""WITH {LAST_SQL} SELECT file, tag, CAST(CASE ord % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 9 ELSE 3 END AS INTEGER) AS typ, CAST(CASE ord % 4 WHEN 2 THEN -val WHEN 3 THEN val % 65536 ELSE val END AS BIGINT) AS num,
  CASE WHEN ord % 4 = 1 THEN CAST(tag + 1 AS BIGINT) END AS den FROM last"""
)
def exif_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF data of JPEG files in both byte orders, by the loader: segments, links, types, later sections over earlier ones."""
    # A file's entries: a directory holds at most 65535.
    rows = b.entries(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "section", "tag", "val"))).alias("entries"))
    files = _mapped(rows, "path string, content binary", _exif_file).select("path", formats.sniff(F.col("content")).alias("format"), "content")
    found = load_exif(files, mode="FAILFAST").select(F.col("path").cast("long").alias("file"), F.explode("exif").alias("tag", "v")).where("tag < 100")
    number = F.coalesce(F.col("v.long")[0], F.col("v.rational")[0]["num"], F.col("v.slong")[0].cast("long"), F.col("v.short")[0].cast("long"))
    return found.select("file", "tag", "v.typ", number.alias("num"), F.col("v.rational")[0]["den"].alias("den"))


# ---- sensor data and pixels ----


def _raw_file(r: dict) -> dict:
    """A RAW file whose second strip stands before its first one."""
    data, half = r["data"], len(r["data"]) // 2

    def made(at: int) -> bytes:
        sizes = [(256, 3, [b.SIDE]), (257, 3, [b.SIDE]), (258, 3, [14]), (259, 3, [1]), (271, 2, b"SONY\0"), (274, 3, [r["vec_id"] % 8 + 1])]
        levels = [1000 * g // b.OVER for g in b.GAINS]
        own = [(exif.BLACK_LEVEL, 3, [b.BLACK] * 4), (exif.WB_LEVELS, 3, [levels[0], levels[1], levels[1], levels[2]])]
        return tiff_bytes([(sizes + [(273, 4, [at + half, at]), (279, 4, [half, half])] + own, None)], "<>"[r["vec_id"] % 2])

    return {"path": str(r["vec_id"]), "content": made(len(made(0))) + data[half:] + data[:half]}


def _pixels(width: int, n: int) -> Column:
    """y, x, r, g, b of a picture's bytes."""
    byte = lambda i, c: formats.unsigned(F.col("data"), 3 * i + c, 1).cast("int")
    one = lambda i: F.struct(F.floor(i / width).cast("int").alias("y"), (i % width).alias("x"), *(byte(i, c).alias(k) for c, k in enumerate("rgb")))
    return F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))


@query(f"WITH {RGB_SQL} SELECT vec_id, CAST({TURN_Y} AS INTEGER) AS y, CAST({TURN_X} AS INTEGER) AS x, r, g, b FROM rgb")
def raw_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW files to upright pictures by the loader: detection, strips, EXIF levels, decoder, demosaic, orientation."""
    files = _mapped(b.plane_bytes(spark, sf_dir), "path string, content binary", _raw_file)
    images = decode_images(files.select("path", formats.sniff(F.col("content")).alias("format"), "content"), mode="FAILFAST")
    return images.select(F.col("path").cast("long").alias("vec_id"), _pixels(b.SIDE, b.SIDE**2))


@query(f"WITH {b.MOSAIC_SQL} SELECT vec_id, y, x, CAST(dn % 4096 AS INTEGER) AS dn FROM mosaic")
def ljpeg_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written as Huffman-coded differences and read by the decoder."""
    files = _mapped(b.planes(spark, sf_dir), "vec_id long, data binary", lambda r: {"vec_id": r["vec_id"], "data": ljpeg_bytes([v % 4096 for v in r["plane"]])})
    return decoded(files, lambda data: raw.arw_ljpeg(data, b.SIDE, b.SIDE))


def _lanczos_sql(name: str, target: int) -> str:
    """t, s, k: weights from the formula."""
    ratio = b.SIDE / target
    sinc = "CASE WHEN {0} = 0 THEN 1::DOUBLE ELSE sin(pi() * {0}) / (pi() * {0}) END"
    x = f"(s + 0.5::DOUBLE - (t + 0.5::DOUBLE) * {ratio}::DOUBLE) / {max(ratio, 1.0)}::DOUBLE"
    v = f"CASE WHEN abs(x) < 3 THEN ({sinc.format('x')}) * ({sinc.format('(x / 3)')}) ELSE 0 END"
    return f"{name} AS (SELECT t, s, v / sum(v) OVER (PARTITION BY t) AS k FROM (SELECT t, s, {v} AS v FROM (SELECT t, s, {x} AS x FROM range({target}) a(t), range({b.SIDE}) c(s))))"


WIDE, HIGH = 5, 12


@query(
    f"""WITH {b.MOSAIC_SQL}, {_lanczos_sql("wx", WIDE)}, {_lanczos_sql("wy", HIGH)}, px AS (SELECT vec_id, y, x, dn % 256 AS r, dn // 64 % 256 AS g, 255 - dn % 256 AS b FROM mosaic),
  a AS (SELECT vec_id, x, t AS ty, sum(r * k) AS r, sum(g * k) AS g, sum(b * k) AS b FROM px JOIN wy ON y = s GROUP BY ALL)
  SELECT vec_id, CAST(ty AS INTEGER) AS y, CAST(t AS INTEGER) AS x, """
    + ", ".join(f"CAST(least(greatest(round_even(sum({c} * k), 0), 0), 255) AS INTEGER) AS {c}" for c in "rgb")
    + " FROM a JOIN wx ON x = s GROUP BY vec_id, ty, t"
)
def resize_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures made narrower and higher by the loader's resampling."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    three = lambda v: F.concat(byte(v % 256), byte(F.floor(v / 64) % 256), byte(255 - v % 256))
    data = F.unhex(F.array_join(F.transform("plane", three), "")).alias("data")
    images = b.planes(spark, sf_dir).select("vec_id", F.lit(b.SIDE).alias("width"), F.lit(b.SIDE).alias("height"), data)
    return resize_images(images, WIDE, HIGH).select("vec_id", _pixels(WIDE, WIDE * HIGH))
