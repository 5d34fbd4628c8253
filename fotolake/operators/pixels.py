"""Pixel operators: numpy kernels for whole images, and expressions over arrays for small planes.

The expression forms work within a row: no shuffle, no self-join, no window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA = 2.2


def _sites(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of red and blue sites (RGGB)."""
    y, x = np.ogrid[:height, :width]
    return (y % 2 == 0) & (x % 2 == 0), (y % 2 == 1) & (x % 2 == 1)


def normalise(raw: np.ndarray, black: int, white: int, gains: tuple[float, float, float]) -> np.ndarray:
    red, blue = _sites(*raw.shape)
    gain = np.where(red, gains[0], np.where(blue, gains[2], gains[1]))
    return np.maximum(raw.astype(np.float64) - black, 0) / max(white - black, 1) * gain


def tone(v: np.ndarray, gamma: float = GAMMA) -> np.ndarray:
    return np.floor(np.clip(v, 0, 1) ** (1 / max(gamma, 0.001)) * 255 + 0.5).astype(np.uint8)


def demosaic(raw: np.ndarray, black: int = 512, white: int = 0x3FFF, gains: tuple[float, float, float] = (1, 1, 1), gamma: float = GAMMA) -> np.ndarray:
    """(height, width, 3) RGB by bilinear interpolation; beyond an edge its own samples stand in."""
    if 0 in raw.shape:
        raise ValueError("empty image")
    v = normalise(raw, black, white, gains)
    h, w = v.shape
    p = np.pad(v, 1, mode="edge")
    near = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    up, down, left, right = near(-1, 0), near(1, 0), near(0, -1), near(0, 1)
    cross = (up + down + left + right) / 4
    diagonal = (near(-1, -1) + near(-1, 1) + near(1, -1) + near(1, 1)) / 4
    flat, upright = (left + right) / 2, (up + down) / 2
    red, blue = _sites(h, w)
    even = (np.arange(h) % 2 == 0)[:, None] & np.ones((1, w), bool)
    r = np.where(red, v, np.where(blue, diagonal, np.where(even, flat, upright)))
    b = np.where(blue, v, np.where(red, diagonal, np.where(even, upright, flat)))
    g = np.where(red | blue, cross, v)
    return tone(np.stack([r, g, b], axis=-1), gamma)


def rotate(rgb: np.ndarray, orientation: int, compat: bool = False) -> np.ndarray:
    """8: a quarter turn to the left.  6: a quarter turn to the right; with compat, sizes are swapped alone.  Others: as is."""
    if orientation == 8:
        return np.rot90(rgb, 1).copy()
    if orientation == 6:
        return rgb.reshape(rgb.shape[1], rgb.shape[0], *rgb.shape[2:]) if compat else np.rot90(rgb, -1).copy()
    return rgb


def lanczos_weights(source: int, target: int, lobes: int = 3, fixed: int | None = None) -> np.ndarray:
    """(target, source) weights of a separable Lanczos resampling; rows sum to 1, or to 2 ** fixed in integers."""
    ratio = source / target
    scale = max(ratio, 1.0)
    centre = (np.arange(target)[:, None] + 0.5) * ratio
    x = (np.arange(source)[None, :] + 0.5 - centre) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    w /= w.sum(axis=1, keepdims=True)
    if fixed is None:
        return w
    whole = np.rint(w * (1 << fixed)).astype(np.int64)
    whole[np.arange(target), np.abs(w).argmax(axis=1)] += (1 << fixed) - whole.sum(axis=1)
    return whole


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    if width <= 0 or height <= 0:
        raise ValueError("empty image")
    rows = np.tensordot(lanczos_weights(rgb.shape[0], height), rgb.astype(np.float64), 1)
    out = np.moveaxis(np.tensordot(lanczos_weights(rgb.shape[1], width), rows, ([1], [1])), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# ---- expressions over a plane in an array column ----


def cfa_colour(y: Column, x: Column) -> Column:
    return F.when((y % 2 == 0) & (x % 2 == 0), "R").when((y % 2 == 1) & (x % 2 == 1), "B").otherwise("G")


def tone_value(v: Column, gamma: float = GAMMA) -> Column:
    inside = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.floor(F.pow(inside, F.lit(1 / max(gamma, 0.001))) * 255 + 0.5).cast("int")


def gain_of(y: Column, x: Column, gains: tuple[int, int, int]) -> Column:
    return F.when((y % 2 == 0) & (x % 2 == 0), gains[0]).when((y % 2 == 1) & (x % 2 == 1), gains[2]).otherwise(gains[1])


def demosaic_array(plane: Column, width: int, height: int, black: int, white: int, gains: tuple[int, int, int], over: int) -> Column:
    """array<struct<y, x, r, g, b>> of a plane of integers.  gains are over ``over``, so that sums stay exact."""

    def of(i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), (i % width).cast("int")

        def v(dy: int, dx: int) -> Column:
            yy = F.least(F.greatest(y + dy, F.lit(0)), F.lit(height - 1))
            xx = F.least(F.greatest(x + dx, F.lit(0)), F.lit(width - 1))
            return F.greatest(F.get(plane, yy * width + xx) - black, F.lit(0)) * gain_of(yy, xx, gains)

        red, blue, even = (y % 2 == 0) & (x % 2 == 0), (y % 2 == 1) & (x % 2 == 1), y % 2 == 0
        flat, upright = 2 * (v(0, -1) + v(0, 1)), 2 * (v(-1, 0) + v(1, 0))
        cross = v(-1, 0) + v(1, 0) + v(0, -1) + v(0, 1)
        diagonal = v(-1, -1) + v(-1, 1) + v(1, -1) + v(1, 1)
        own = 4 * v(0, 0)
        r = F.when(red, own).when(blue, diagonal).when(even, flat).otherwise(upright)
        b = F.when(blue, own).when(red, diagonal).when(even, upright).otherwise(flat)
        g = F.when(red | blue, cross).otherwise(own)
        full = float(4 * over * max(white - black, 1))
        return F.struct(y.alias("y"), x.alias("x"), *[tone_value(c.cast("double") / full).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), of)


def rotate270_index(width: int, height: int, y: Column, x: Column) -> tuple[Column, Column]:
    """Where a pixel goes when the picture turns left."""
    return F.lit(width - 1) - x, y
