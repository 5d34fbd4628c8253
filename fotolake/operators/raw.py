"""Sensor data decoders, in numpy and free of Spark: bytes in, a plane of 16-bit samples out."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class DecodeError(ValueError):
    """Data that can't be decoded; its text becomes the message of an error row."""


# Fixed values: (bits, symbol) of the Huffman codes, longest first.
CODES = (
    (15, 17), (15, 16), (14, 15), (13, 14), (12, 13), (11, 12), (10, 11), (9, 10), (8, 9), (7, 8), (6, 7), (5, 6), (4, 5), (3, 4), (3, 3), (3, 0), (2, 2), (2, 1),
)
WHITE = {"arw2": 0x3FFF, "uncompressed14": 0x3FFF, "arw_ljpeg": 0x0FFF}


def _check(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise DecodeError("empty image")


def uncompressed14(data: bytes, width: int, height: int) -> np.ndarray:
    """Little-endian 16-bit words; the upper two bits are not masked."""
    _check(width, height)
    if len(data) < 2 * width * height:
        raise DecodeError("unexpected end of data")
    return np.frombuffer(data, "<u2", width * height).reshape(height, width).copy()


def arw2(data: bytes, width: int, height: int) -> np.ndarray:
    """Blocks of 16 bytes hold 16 samples: two extremes, their places, and 14 codes of 7 bits.

    All blocks are decoded at once, a sample place at a time.  Samples beyond the last whole block stay 0.
    """
    _check(width, height)
    if len(data) < width * height:
        raise DecodeError("unexpected end of data")
    per = width // 16
    out = np.zeros((height, width), np.uint16)
    if not per:
        return out
    rows = np.frombuffer(data, np.uint8, width * height).reshape(height, width)
    # Where both places are the same a fifteenth code is read, partly from beyond the block.
    padded = np.concatenate([rows, np.zeros((height, 1), np.uint8)], axis=1).astype(np.int64)
    base = np.arange(per) * 16
    head = sum(padded[:, base + k] << (8 * k) for k in range(4))
    top, low = head & 0x7FF, head >> 11 & 0x7FF
    at_top, at_low = head >> 22 & 15, head >> 26 & 15
    shift = sum((np.int64(0x80 << k) <= top - low).astype(np.int64) for k in range(4))
    bit = np.full_like(head, 30)
    for i in range(16):
        coded = (at_top != i) & (at_low != i)
        place = base + (bit >> 3)
        if (coded & (place + 1 > width)).any():
            raise DecodeError("row buffer overread")
        place = np.minimum(place, width - 1)
        two = np.take_along_axis(padded, place, 1) | np.take_along_axis(padded, place + 1, 1) << 8
        value = ((two >> (bit & 7) & 0x7F) << shift) + low
        out[:, base + i] = np.where(at_top == i, top, np.where(at_low == i, low, value)).astype(np.uint16)
        bit = bit + 7 * coded
    return out


@lru_cache(maxsize=2)
def huffman(compat: bool = False) -> tuple[list[int], list[int]]:
    """Bits and symbol for every window of 15 bits.  compat: the table is read one place early."""
    bits = np.repeat([b for b, _ in CODES], [32768 >> b for b, _ in CODES])
    symbols = np.repeat([s for _, s in CODES], [32768 >> b for b, _ in CODES])
    if compat:
        bits, symbols = np.r_[0, bits[:-1]], np.r_[15, symbols[:-1]]
    return bits.tolist(), symbols.tolist()


@lru_cache(maxsize=2)
def _tables(compat: bool) -> tuple[np.ndarray, np.ndarray]:
    bits, symbols = huffman(compat)
    return np.array(bits), np.array(symbols)


def difference(value: int, length: int, dng: int | None = None) -> int:
    if length == 0:
        return 0
    if length == 16 and (not dng or dng >= 0x1010000):
        return -32768
    return value if value >> (length - 1) & 1 else value - (1 << length) + 1


def _unstuffed(data: bytes) -> bytes:
    """The bytes up to the first marker, with FF 00 for FF."""
    at = 0
    while (at := data.find(b"\xff", at)) >= 0:
        if data[at + 1 : at + 2] != b"\x00":
            return data[:at].replace(b"\xff\x00", b"\xff")
        at += 2
    return data.replace(b"\xff\x00", b"\xff")


def _differences(data: bytes, n: int, dng: int | None, compat: bool, block: int = 1 << 17) -> tuple[np.ndarray, str | None]:
    """The first n differences, or those before the data ends and what is missing there.

    How far a code reaches is looked up for every bit of a block at once; a loop then only hops from code to code.
    """
    bits, symbols = _tables(compat)
    extra = symbols.copy()
    if not dng or dng >= 0x1010000:
        extra[symbols == 16] = 0
    size = 8 * len(data)
    whole = np.frombuffer(data + bytes(8), np.uint8)
    parts, at, done = [], 0, 0
    while done < n and at < size:
        first = at >> 3
        own = whole[first : first + block + 8].astype(np.int64)
        five = sum(own[k : len(own) - 4 + k] << (32 - 8 * k) for k in range(5))
        window = five[: min(block, len(five)), None] >> (25 - np.arange(8)) & 0x7FFF
        hops = (bits + extra)[window].ravel().tolist()
        base, places = 8 * first, []
        end = min(size - base, len(hops))
        here = at - base
        while here < end and done < n:
            places.append(here)
            here += hops[here]
            done += 1
        at = base + here
        p = np.array(places)
        c = window[p >> 3, p & 7]
        q = p + bits[c]
        # A code at the end of a block has its bits within the eight bytes behind it.
        value = five[np.minimum(q >> 3, len(five) - 1)] >> (40 - (q & 7) - extra[c]) & ((1 << extra[c]) - 1)
        plus = np.where(value >> np.maximum(extra[c] - 1, 0) & 1, value, value - (1 << extra[c]) + 1)
        parts.append(np.where(extra[c] > 0, plus, np.where(symbols[c] == 16, -32768, 0)))
        code_end = base + int(q[-1])
    found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if at > size:
        return found[:-1], "code" if code_end > size else "bits"
    if done < n:  # at the very end, where a window is 0
        return found, "code" if bits[0] else "bits"
    return found, None


def arw_ljpeg(data: bytes, width: int, height: int, dng: int | None = None, compat: bool = False, extra_rows: int = 8) -> np.ndarray:
    """Huffman-coded differences, summed through the whole plane: columns from the right, even rows and then odd ones.

    The plane has extra_rows more rows than come out; odd rows are only there if its height is even.
    """
    _check(width, height)
    total = height + extra_rows
    order = np.array([*range(0, total, 2), *(range(1, total, 2) if total % 2 == 0 else ())])
    found, missing = _differences(_unstuffed(data), width * len(order), dng, compat)
    acc = np.cumsum(found)
    if ((acc < 0) | (acc >= 4096)).any():
        raise DecodeError("accumulator overflow")
    if missing:
        raise DecodeError(f"{missing} beyond the end of data")
    out = np.zeros((height, width), np.uint16)
    there = order < height
    out[order[there]] = acc.reshape(width, len(order))[::-1, there].T
    return out


def decode(variant: str, data: bytes, width: int, height: int, dng: int | None = None, compat: bool = False) -> np.ndarray:
    if variant == "arw2":
        return arw2(data, width, height)
    if variant == "uncompressed14":
        return uncompressed14(data, width, height)
    if variant == "arw_ljpeg":
        return arw_ljpeg(data, width, height, dng, compat)
    raise DecodeError(f"unsupported raw format: {variant}")
