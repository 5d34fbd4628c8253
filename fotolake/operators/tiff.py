"""TIFF and EXIF structure, free of Spark: bytes in, plain Python values out.

Reads are bounded by the file: counts and offsets beyond its end raise BadFile or skip the entry.
compat=True reads short big-endian values the way an old reader did, with their four bytes reversed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from fotolake.functions.exif import SIZES


class BadFile(ValueError):
    """A file that can't be read as asked; its text becomes the message of an error row."""


@dataclass
class Entry:
    tag: int
    typ: int
    count: int
    raw: bytes  # the four bytes as they stand in the file


@dataclass
class Directory:
    entries: list[Entry]
    following: int

    def first(self, tag: int) -> Entry | None:
        return next((e for e in self.entries if e.tag == tag), None)


@dataclass
class RawInfo:
    width: int
    height: int
    bits: int
    compression: int
    offsets: list[int]
    counts: list[int]
    sony: bool
    make: str | None = None
    model: str | None = None
    dng: int | None = None
    variant: str = "unknown"
    visited: list[int] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(self.counts)


class Reader:
    """Numbers, directories and values of one TIFF structure; base is where its header stands."""

    def __init__(self, data: bytes, base: int = 0, compat: bool = False):
        self.data, self.base = data, base
        mark = data[base : base + 2]
        if mark not in (b"II", b"MM"):
            raise BadFile("not a TIFF file")
        self.order = "<" if mark == b"II" else ">"
        self.swapped = compat and self.order == ">"
        if len(data) < base + 8:
            raise BadFile("unexpected end of file")
        if self.number(base + 2, 2) != 42:
            raise BadFile("bad TIFF magic")
        self.start = self.number(base + 4, 4)

    def number(self, at: int, width: int) -> int:
        if at < 0 or at + width > len(self.data):
            raise BadFile("unexpected end of file")
        return int.from_bytes(self.data[at : at + width], "little" if self.order == "<" else "big")

    def directory(self, at: int) -> Directory:
        n = self.number(at, 2)
        if at + 2 + 12 * n + 4 > len(self.data):
            raise BadFile("unexpected end of file")
        entries = [Entry(*struct.unpack_from(self.order + "HHI", self.data, p), self.data[p + 8 : p + 12]) for p in range(at + 2, at + 2 + 12 * n, 12)]
        return Directory(entries, self.number(at + 2 + 12 * n, 4))

    def value_bytes(self, e: Entry, size: int) -> bytes:
        if size <= 4:
            return (e.raw[::-1] if self.swapped else e.raw)[:size]
        at = self.base + self.pointer(e)
        if at + size > len(self.data):
            raise BadFile("unexpected end of file")
        return self.data[at : at + size]

    def pointer(self, e: Entry) -> int:
        return int.from_bytes(e.raw, "little" if self.order == "<" else "big")

    def numbers(self, e: Entry, code: str) -> list[int]:
        size = struct.calcsize(code) * e.count
        return list(struct.unpack(f"{self.order}{e.count}{code}", self.value_bytes(e, size)))

    def value(self, e: Entry) -> dict | None:
        """One member of the value struct, or null for types that are skipped."""
        if e.typ not in SIZES:
            return None
        data = self.value_bytes(e, SIZES[e.typ] * e.count)
        out: dict = {"typ": e.typ, "count": e.count}
        if e.typ in (1, 7):
            out["bytes"] = data
        elif e.typ == 2:
            out["ascii"] = text(data)
        else:
            code, name = {3: ("H", "short"), 8: ("H", "short"), 4: ("I", "long"), 5: ("I", "rational"), 9: ("i", "slong"), 10: ("i", "srational")}[e.typ]
            many = struct.unpack(f"{self.order}{len(data) // struct.calcsize(code)}{code}", data)
            out[name] = list(zip(many[::2], many[1::2], strict=False)) if "rational" in name else list(many)
        return out

    def link(self, d: Directory, tag: int) -> int | None:
        """Where a sub-directory stands; null if there is no usable pointer."""
        e = d.first(tag)
        if e is None or e.count < 1 or e.typ not in (3, 4) or (e.typ == 3 and e.count != 1):
            return None
        try:
            if e.count > 1:
                at = self.number(self.base + self.pointer(e), 4)
            else:
                width = 2 if e.typ == 3 else 4
                at = int.from_bytes(self.value_bytes(e, width), "little" if self.order == "<" else "big")
        except BadFile:
            return None
        return self.base + at or None


def text(data: bytes) -> str:
    """UTF-8, with replacement characters, without one NUL at the end."""
    return (data[:-1] if data.endswith(b"\0") else data).decode("utf-8", "replace")


# ---- EXIF ----


def sniff(data: bytes) -> str:
    from fotolake.functions.formats import MAGIC

    if len(data) < 2:
        raise BadFile("unexpected end of file")
    kind = MAGIC.get(data[:2].hex().upper())
    if kind is None:
        raise BadFile("unsupported image format")
    return kind


def exif(data: bytes, compat: bool = False) -> dict[int, dict]:
    """Tag to value.  WebP and PDF have none; a JPEG without an Exif segment is an error, and so is RAW that isn't."""
    kind = sniff(data)
    if kind == "jpeg":
        return exif_of_tiff(data, jpeg_exif_offset(data), compat)
    if kind == "png":
        return png_header(data)
    if kind == "raw":
        raw_info(data, compat)
        return exif_of_tiff(data, 0, compat)
    return {}


def png_header(data: bytes) -> dict[int, dict]:
    if data[:16] != b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR":
        raise BadFile("not a PNG header")
    if len(data) < 24:
        raise BadFile("unexpected end of file")
    size = struct.unpack_from(">II", data, 16)
    return {256 + k: {"typ": 4, "count": 1, "long": [v]} for k, v in enumerate(size)}


def jpeg_exif_offset(data: bytes) -> int:
    """Where the TIFF header of the Exif segment stands.  Fill bytes and other segments are passed over."""
    if data[:2] != b"\xff\xd8":
        raise BadFile("no EXIF data")
    at = 2
    while True:
        at = data.find(b"\xff", at)
        if at < 0:
            raise BadFile("no EXIF data")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            raise BadFile("unexpected end of file")
        marker = data[at]
        if marker in (0xD9, 0xDA):
            raise BadFile("no EXIF data")
        if at + 3 > len(data):
            raise BadFile("unexpected end of file")
        length = int.from_bytes(data[at + 1 : at + 3], "big")
        body = at + 3
        if marker == 0xE1:
            if body + 6 > len(data):
                raise BadFile("unexpected end of file")
            if data[body : body + 6] == b"Exif\0\0":
                return body + 6
            at = body + max(6, length - 2)
        else:
            at = body + max(0, length - 2)


def exif_of_tiff(data: bytes, base: int, compat: bool = False) -> dict[int, dict]:
    """Entries of the first directory, then its Exif directory, then its first sub-directory: later ones win."""
    r = Reader(data, base, compat)
    first = r.directory(base + r.start)
    parts = [first]
    for tag in (0x8769, 0x014A):
        at = r.link(first, tag)
        if at is not None:
            parts.append(r.directory(at))
    out: dict[int, dict] = {}
    for part in parts:
        for e in part.entries:
            try:
                v = r.value(e)
            except BadFile:
                continue
            if v is not None:
                out[e.tag] = v
    return out


# ---- RAW detection ----


def raw_info(data: bytes, compat: bool = False) -> RawInfo:
    """The directory with the most sensor data, over all that can be reached; of equals the first met."""
    r = Reader(data, 0, compat)
    todo, seen = [r.start], []
    make = model = dng = best = None
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.append(at)
        d = r.directory(at)
        make = make or _text(r, d, 271)
        model = model or _text(r, d, 272)
        dng = _version(r, d) if dng is None else dng
        sub = d.first(330)
        if sub is not None:
            todo += _longs(r, sub, compat)
        found = _candidate(r, d, make, compat)
        if found and found.total > (best.total if best else 0):
            best = found
        if d.following:
            todo.append(d.following)
    if best is None:
        raise BadFile("no RAW directory found")
    best.make, best.model, best.dng, best.visited = make, model, dng, seen
    best.variant = variant(best)
    return best


def variant(i: RawInfo) -> str:
    pixels = i.width * i.height
    words = i.dng is None and i.sony and i.total == 2 * pixels
    if i.compression == 32767:
        if i.dng is None and i.total == pixels:
            return "arw2"
        return "uncompressed14" if words else "arw_ljpeg" if 8 * i.total != pixels * i.bits else "unknown"
    return "uncompressed14" if i.compression in (0, 1) and words else "unknown"


def _text(r: Reader, d: Directory, tag: int) -> str | None:
    e = d.first(tag)
    return text(r.value_bytes(e, e.count)) or None if e and e.typ == 2 and e.count else None


def _version(r: Reader, d: Directory) -> int | None:
    e = d.first(0xC612)
    return int.from_bytes(r.value_bytes(e, e.count)[:4], "big") if e and e.typ == 1 and e.count >= 4 else None


def _longs(r: Reader, e: Entry, compat: bool) -> list[int]:
    """Numbers of an entry; with compat its type is not looked at."""
    return r.numbers(e, "H") if e.typ == 3 and not compat else r.numbers(e, "I")


def _candidate(r: Reader, d: Directory, make: str | None, compat: bool) -> RawInfo | None:
    need = [d.first(t) for t in (256, 257, 273, 279)]
    lists = [_longs(r, e, compat) if e else [] for e in need]
    if not all(lists) or len(lists[2]) != len(lists[3]):
        return None

    def short(tag: int, default: int) -> int:
        e = d.first(tag)
        return r.numbers(e, "H")[0] if e and e.typ == 3 and e.count else default

    if short(277, 1) != 1:
        return None
    sony = (make or "").lower().startswith("sony")
    return RawInfo(lists[0][0], lists[1][0], short(258, 14), short(259, 1), lists[2], lists[3], sony)


def strips(data: bytes, offsets: list[int], counts: list[int]) -> bytes:
    """Strips one after another; where one list is shorter it ends both."""
    parts = []
    for at, n in zip(offsets, counts, strict=False):
        if at + n > len(data):
            raise BadFile("unexpected end of file")
        parts.append(data[at : at + n])
    return b"".join(parts)
