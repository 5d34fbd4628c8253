"""PNG with zlib alone: reading to 8-bit RGB, and writing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def write_png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """RGB of a PNG that is not interlaced.  Alpha is left out, 16 bits are scaled to 8, grey is repeated."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, idat, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise ValueError("unexpected end of file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[3] not in CHANNELS or head[6] or head[0] * head[1] == 0:
        raise ValueError("unsupported PNG")
    w, h, depth, colour = head[:4]
    ch = CHANNELS[colour]
    line, step = -(-w * ch * depth // 8), max(1, ch * depth // 8)
    raw = zlib.decompressobj().decompress(b"".join(idat), h * (line + 1))
    if len(raw) < h * (line + 1):
        raise ValueError("unexpected end of file")
    rows = np.frombuffer(raw, np.uint8).reshape(h, line + 1)
    out = np.zeros((h + 1, line), np.uint8)
    for y in range(h):
        out[y + 1] = _unfilter(int(rows[y, 0]), rows[y, 1:], out[y], step)
    px = out[1:]
    if depth == 16:
        px = np.rint(px.reshape(h, w * ch, 2).astype(np.uint32) @ np.array([256, 1]) / 257).astype(np.uint8)
    elif depth < 8:
        bits = np.unpackbits(px, axis=1)[:, : w * depth].reshape(h, w, depth)
        px = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
        if colour != 3:
            px = (px.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    px = px.reshape(h, w, ch)
    if colour == 3:
        if palette is None or px.max() >= len(palette):
            raise ValueError("bad PNG palette")
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if ch < 3 else px[:, :, :3].copy()


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out = np.zeros(len(row) + step, np.int64)
    row, up = row.astype(np.int64), np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    if kind == 1:
        for k in range(step):
            out[step + k :: step] = np.cumsum(row[k::step]) & 255
        return out[step:].astype(np.uint8)
    if kind not in (3, 4):
        raise ValueError("bad PNG filter")
    for i in range(len(row)):
        a, b, c = int(out[i]), int(up[i + step]), int(up[i])
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i + step] = (row[i] + guess) & 255
    return out[step:].astype(np.uint8)
