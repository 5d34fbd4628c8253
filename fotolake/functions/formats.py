"""Formats and RAW variants as built-in expressions: no Python runs on executors, so Catalyst can push them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first two bytes of each format.
MAGIC = {"FFD8": "jpeg", "8950": "png", "5249": "webp", "2550": "pdf", "4949": "raw", "4D4D": "raw"}


def sniff(content: Column) -> Column:
    """The format that the first two bytes name; "unsupported" for others, "io_error" for less than two bytes.

    Only these bytes count: any file that starts with RI is taken for WebP.
    """
    head = F.hex(F.substring(content, 1, 2))
    out = F.when(content.isNull() | (F.octet_length(content) < 2), F.lit("io_error"))
    for magic, name in MAGIC.items():
        out = out.when(head == magic, F.lit(name))
    return out.otherwise(F.lit("unsupported"))


def unsigned(content: Column, at: int | Column, width: int, little: bool = True) -> Column:
    """An unsigned integer of ``width`` bytes at offset ``at`` (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    total = F.lit(0).cast("long")
    for k in range(width):
        byte = F.conv(F.hex(F.substring(content, at + (k + 1), F.lit(1))), 16, 10).cast("long")
        total = total + F.shiftleft(byte, 8 * (k if little else width - 1 - k))
    return total


def png_size(content: Column) -> Column:
    """struct<width, height> from a PNG header, null where the first 16 bytes are no PNG signature with IHDR."""
    start = F.hex(F.substring(content, 1, 16)) == "89504E470D0A1A0A0000000D49484452"
    there = start & (F.octet_length(content) >= 24)
    return F.when(there, F.struct(unsigned(content, 16, 4, False).alias("width"), unsigned(content, 20, 4, False).alias("height")))


def raw_variant(compression: Column, width: Column, height: Column, bits: Column, total: Column, dng: Column, sony: Column) -> Column:
    """The kind of sensor data: arw2, arw_ljpeg, uncompressed14 or unknown."""
    pixels = width.cast("long") * height
    words = dng.isNull() & sony & (total == pixels * 2)
    own = F.when(dng.isNull() & (total == pixels), "arw2").when(words, "uncompressed14").when(total * 8 != pixels * bits, "arw_ljpeg").otherwise("unknown")
    return F.when(compression == 32767, own).when(compression.isin(0, 1) & words, "uncompressed14").otherwise("unknown")


def is_sony(make: Column) -> Column:
    return F.coalesce(F.lower(make).startswith("sony"), F.lit(False))


def dng_version(b0: Column, b1: Column, b2: Column, b3: Column) -> Column:
    """Four version bytes in one number, the first the most significant."""
    wide = [x.cast("long") for x in (b0, b1, b2, b3)]
    return F.shiftleft(wide[0], 24).bitwiseOR(F.shiftleft(wide[1], 16)).bitwiseOR(F.shiftleft(wide[2], 8)).bitwiseOR(wide[3])


def ljpeg_difference(bits: Column, length: Column, dng: Column) -> Column:
    """The signed difference of ``length`` bits; 16 bits mean -32768 without an old DNG version."""
    v, n = bits.cast("long"), length.cast("int")
    half = F.call_function("shiftleft", F.lit(1).cast("long"), n - 1)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    special = (n == 16) & (dng.isNull() | (dng == 0) | (dng >= 0x1010000))
    return F.when(n == 0, F.lit(0).cast("long")).when(special, F.lit(-32768).cast("long")).when(v.bitwiseAND(half) == 0, v - full).otherwise(v)
