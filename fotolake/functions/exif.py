"""EXIF values as columns: sizes, lookups, merged sections, display.  The value type is a struct of optionals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
VALUE = T.StructType(
    [
        T.StructField("typ", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("bytes", T.BinaryType()), T.StructField("ascii", T.StringType()),
        T.StructField("short", T.ArrayType(T.IntegerType())), T.StructField("long", T.ArrayType(T.LongType())), T.StructField("rational", T.ArrayType(PAIR)),
        T.StructField("slong", T.ArrayType(T.IntegerType())), T.StructField("srational", T.ArrayType(PAIR)),
    ]
)
EXIF = T.MapType(T.IntegerType(), VALUE)
# Bytes of each wire type that can be read.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 8: 2, 9: 4, 10: 8}
# Tags that the engine itself reads.
ORIENTATION, BLACK_LEVEL, WB_LEVELS = 0x0112, 0x7310, 0x7313
#: Sections in the order in which later ones win.
SECTIONS = ("ifd0", "exif", "sub")


def type_size(typ: Column) -> Column:
    """Bytes of a wire type; null for types that are skipped."""
    out = F.lit(None).cast("int")
    for k, v in SIZES.items():
        out = F.when(typ == k, F.lit(v)).otherwise(out)
    return out


def exif_value(exif: Column, tag: int | Column) -> Column:
    """The value of a tag, or null."""
    return F.try_element_at(exif, F.lit(tag) if isinstance(tag, int) else tag)


def exif_bytes(value: Column) -> Column:
    """A value as (typ, bytes): little-endian bytes for the one or many numbers, UTF-8 for text, null if missing."""
    le = lambda x, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * (k + 1), 2) for k in range(n)]))
    join = lambda parts: F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    many = lambda a, n: join(F.transform(a, lambda x: le(x, n)))
    pairs = lambda a: join(F.transform(a, lambda x: F.concat(le(x["num"], 4), le(x["den"], 4))))
    data = F.coalesce(
        value["bytes"], F.encode(value["ascii"], "utf-8"), many(value["short"], 2), many(value["long"], 4),
        pairs(value["rational"]), many(value["slong"], 4), pairs(value["srational"]),
    )
    return F.when(value.isNotNull(), F.struct(value["typ"].alias("typ"), data.alias("data")))


def display(name: Column, value: Column) -> Column:
    """A line of text: the name in 30 columns, and the value or its beginning."""
    first = lambda a: F.get(a, F.lit(0))
    pair = lambda a: F.concat(first(a)["num"].cast("string"), F.lit("/"), first(a)["den"].cast("string"))
    hexed = F.hex(value["bytes"])
    some = F.transform(F.sequence(F.lit(1), F.least(F.octet_length(value["bytes"]), F.lit(8))), lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10))
    head = F.when(F.octet_length(value["bytes"]) > 0, F.array_join(some, ", ")).otherwise("")
    body = (
        F.when(value["ascii"].isNotNull(), value["ascii"])
        .when(F.size(value["rational"]) > 0, pair(value["rational"]))
        .when(F.size(value["srational"]) > 0, F.concat(pair(value["srational"]), F.lit(" (signed)")))
        .when(F.size(value["short"]) > 0, first(value["short"]).cast("string"))
        .when(F.size(value["long"]) > 0, first(value["long"]).cast("string"))
        .when(value["bytes"].isNotNull(), F.concat(F.lit("["), head, F.lit("] ("), F.octet_length(value["bytes"]).cast("string"), F.lit(" bytes)")))
        .otherwise("<value>")
    )
    return F.concat(F.when(F.length(name) < 30, F.rpad(name, 30, " ")).otherwise(name), F.lit(": "), body)


def to_json(exif: Column) -> Column:
    """A JSON object of tag to tagged value, such as {"274":{"Short":[6]}}."""
    pairs = lambda a: F.transform(a, lambda x: F.array(x["num"], x["den"]))
    number = lambda v: F.when(v["ascii"].isNotNull(), F.to_json(F.struct(v["ascii"].alias("Ascii"))))

    def one(v: Column) -> Column:
        out = number(v)
        for field, name in (("short", "Short"), ("long", "Long"), ("slong", "SLong")):
            out = out.when(v[field].isNotNull(), F.to_json(F.struct(v[field].alias(name))))
        for field, name in (("rational", "Rational"), ("srational", "SRational")):
            out = out.when(v[field].isNotNull(), F.to_json(F.struct(pairs(v[field]).alias(name))))
        hexed = F.hex(v["bytes"])
        values = F.transform(F.sequence(F.lit(1), F.octet_length(v["bytes"])), lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
        return out.when(v["bytes"].isNotNull(), F.to_json(F.struct(F.when(F.octet_length(v["bytes"]) > 0, values).otherwise(F.array().cast("array<int>")).alias("Byte"))))

    items = F.transform(F.map_entries(exif), lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('":'), one(e["value"])))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def black_level(exif: Column) -> Column:
    return F.coalesce(F.get(exif_value(exif, BLACK_LEVEL)["short"], F.lit(0)), F.lit(512))


def white_balance(exif: Column) -> Column:
    """Gains of red, green and blue from the first, second and fourth of four levels, in thousandths."""
    levels = exif_value(exif, WB_LEVELS)["short"]
    there = F.size(levels) >= 4
    return F.array(*[F.when(there, F.get(levels, F.lit(i)) / F.lit(1000.0)).otherwise(F.lit(1.0)) for i in (0, 1, 3)])


def overlay(entries: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row for each key: the values of the entry that comes last.  One partial aggregation, no sort."""
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last")).select(*keys, "last.*")


def section_rank(section: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SECTIONS):
        out = F.when(section == s, F.lit(i)).otherwise(out)
    return out


def read_catalogue(path: str) -> list[tuple[int, str, str]]:
    """(tag, name, section) rows of a listing such as "### IFD0 (2)" and then "0x0100 ImageWidth; 0x0101 ImageHeight."

    The full catalogue is a parameter; it is not part of the code.
    """
    rows, section = [], None
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := re.match(r"### (\w+) \(\d+\)", line):
                section = m[1]
            elif section:
                rows += [(int(t, 16), n, section) for t, n in re.findall(r"(0x[0-9a-fA-F]{4}) (\S+)", line)]
    return rows


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(read_catalogue(path), "tag int, name string, section string")


def with_names(entries: DataFrame, tags: DataFrame) -> DataFrame:
    """entries with the name and section of their tag.  tags has a row for each of 65,536 tags at most."""
    return entries.join(F.broadcast(tags), "tag", "left")
