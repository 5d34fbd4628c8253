"""Golden vectors and properties of the sensor data decoders and pixel kernels."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fotolake.operators import pixels, raw
from fotolake.plans.files import ljpeg_bytes

GOLDEN = [
    (600, 100, "5822832420201814108d8ae89625e3ff", "100 104 600 108 112 120 132 152 184 100 236 320 456 500 580 608"),
    (300, 200, "2c41862420201814108d8ae89625e3ff", "200 201 300 202 203 205 208 213 221 200 234 255 289 300 320 327"),
    (2047, 0, "ff07802420201814108d8ae89625e3ff", "0 16 2047 32 48 80 128 208 336 0 544 880 1424 1600 1920 2032"),
    (100, 600, "64c0922420201814108d8ae89625e3ff", "600 601 100 602 603 605 608 613 621 600 634 655 689 700 720 727"),
]


@pytest.mark.parametrize("top,low,data,want", GOLDEN)
def test_arw2_blocks(top, low, data, want):
    assert raw.arw2(bytes.fromhex(data), 16, 1)[0].tolist() == list(map(int, want.split()))


def test_arw2_same_place_twice():
    block = bytearray(bytes.fromhex(GOLDEN[0][2]))
    head = int.from_bytes(block[:4], "little")
    head = head & ~(15 << 26) | 2 << 26
    block[:4] = head.to_bytes(4, "little")
    with pytest.raises(raw.DecodeError, match="overread"):
        raw.arw2(bytes(block), 16, 1)
    two = raw.arw2(bytes(block) + bytes.fromhex(GOLDEN[0][2]), 32, 1)
    assert two[0, :16].tolist() == [100, 104, 600, 108, 112, 120, 132, 152, 184, 236, 320, 456, 500, 580, 608, 452]


def test_arw2_rest_of_a_row_stays_zero():
    data = bytes.fromhex(GOLDEN[0][2]) + bytes([9] * 8)
    out = raw.arw2(data * 2, 24, 2)
    assert (out[:, 16:] == 0).all() and (out[0, :16] == out[1, :16]).all()
    with pytest.raises(raw.DecodeError):
        raw.arw2(data, 24, 2)


def test_uncompressed14():
    assert raw.uncompressed14(bytes.fromhex("34123f00ffff"), 3, 1).tolist() == [[4660, 63, 65535]]
    for size in ((0, 1), (1, 0)):
        with pytest.raises(raw.DecodeError):
            raw.uncompressed14(b"", *size)


@pytest.mark.parametrize("bits,length,want", [(0, 1, -1), (1, 1, 1), (0, 3, -7), (3, 3, -4), (4, 3, 4), (7, 3, 7), (0, 0, 0), (5, 16, -32768)])
def test_difference(bits, length, want):
    assert raw.difference(bits, length) == want


def test_difference_of_16_bits_in_old_dng():
    assert raw.difference(0x8000, 16, 0x1000000) == 0x8000 and raw.difference(0x8000, 16, 0x1010000) == -32768


def test_huffman_readings_differ_in_18_windows():
    a, b = raw.huffman(), raw.huffman(True)
    assert [len(x) for x in (*a, *b)] == [32768] * 4
    differ = [c for c in range(32768) if (a[0][c], a[1][c]) != (b[0][c], b[1][c])]
    assert differ == [0, 1, 2, 4, 8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x6000]
    assert (b[0][0], b[1][0]) == (0, 15)


def encode(plane: np.ndarray, extra: int = 8) -> bytes:
    """The inverse of arw_ljpeg, from the table of codes."""
    start = {}
    at = 0
    for bits, symbol in raw.CODES:
        start[symbol] = (at >> (15 - bits), bits)
        at += 32768 >> bits
    h, w = plane.shape
    total = h + extra
    order = [*range(0, total, 2), *(range(1, total, 2) if total % 2 == 0 else [])]
    out, acc = "", 0
    for col in range(w - 1, -1, -1):
        for row in order:
            v = int(plane[row, col]) if row < h else acc
            d, acc = v - acc, v
            n = abs(d).bit_length()
            code, bits = start[n]
            out += f"{code:0{bits}b}"
            if n:
                out += f"{d if d > 0 else d + (1 << n) - 1:0{n}b}"
    out += "1" * (-len(out) % 8)
    data = int(out, 2).to_bytes(len(out) // 8, "big")
    return data.replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("h,w", [(2, 3), (4, 5), (6, 16)])
def test_ljpeg_round_trip(h, w):
    r = random.Random(h)
    plane = np.array([[r.randrange(4096) if r.random() < 0.3 else 2000 + r.randrange(50) for _ in range(w)] for _ in range(h)])
    data = encode(plane)
    assert (raw.arw_ljpeg(data + b"\xff\xd9", w, h) == plane).all()
    with pytest.raises(raw.DecodeError):
        raw.arw_ljpeg(data[: len(data) // 2], w, h)


def test_ljpeg_odd_height_has_no_odd_rows():
    plane = np.zeros((3, 2), int)
    plane[::2] = 77
    assert (raw.arw_ljpeg(encode(plane), 2, 3)[1] == 0).all()


def test_ljpeg_overflow():
    with pytest.raises(raw.DecodeError, match="overflow"):
        raw.arw_ljpeg(b"\x00" * 64, 1, 2)


def test_tone_curve():
    assert pixels.tone(np.array([0, 0.18, 0.25, 0.5, 1.0, 2, -1])).tolist() == [0, 117, 136, 186, 255, 255, 0]


def test_demosaic_golden():
    y, x = np.mgrid[:4, :4]
    got = pixels.demosaic(1000 + 500 * y + 100 * x, 512, 16383, (2.0, 1.0, 1.5))
    want = """72,69,74 78,57,76 84,72,80 75,65,83 99,72,82 103,75,91 108,78,94 96,85,98
      119,97,98 123,90,108 126,92,111 112,95,114 110,99,111 113,104,122 116,104,125 114,114,127"""
    assert got.reshape(-1, 3).tolist() == [list(map(int, p.split(","))) for p in want.split()]
    with pytest.raises(ValueError):
        pixels.demosaic(np.zeros((0, 4)))


def test_orientation():
    a = np.arange(6).reshape(2, 3, 1)
    assert pixels.rotate(a, 8)[..., 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert pixels.rotate(a, 6)[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert pixels.rotate(a, 6, compat=True)[..., 0].tolist() == [[0, 1], [2, 3], [4, 5]]
    for k in (0, 1, 2, 3, 4, 5, 7):
        assert (pixels.rotate(a, k) == a).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 20), st.integers(1, 20), st.integers(0, 255))
def test_resize_keeps_flat_pictures(h, w, th, tw, level):
    out = pixels.resize(np.full((h, w, 3), level, np.uint8), tw, th)
    assert out.shape == (th, tw, 3) and (out == level).all()
    assert (pixels.lanczos_weights(w, tw, fixed=14).sum(axis=1) == 1 << 14).all()


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 17])
def test_differences_do_not_depend_on_the_block(block):
    rng = random.Random(3)
    plane = [min(4095, max(0, 2000 + rng.randint(-900, 900))) for _ in range(256)]
    data = ljpeg_bytes(plane, 16)
    assert raw.arw_ljpeg(data, 16, 16).ravel().tolist() == plane
    clean = raw._unstuffed(data)
    found, missing = raw._differences(clean, 16 * 24, None, False, block)
    assert missing is None and (found == raw._differences(clean, 16 * 24, None, False)[0]).all()
    assert raw._differences(clean[:-9], 16 * 24, None, False, block)[1] in ("code", "bits")
