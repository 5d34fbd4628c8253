"""Hashes of many parts of a byte string at once, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

FACTOR = 0x2545F4914F6CDD1D
#: Longer parts are hashed one by one; shorter ones differ in a polynomial of low degree.
SHORT, STEP = 64, 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2 ** 64."""
    if not _POWERS:
        for f in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.r_[np.uint64(1), np.full(STEP + SHORT, np.uint64(f), np.uint64)], dtype=np.uint64))
    return _POWERS


def part_hashes(raw: bytes, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each part raw[start:stop], by differences of a running sum.  start is ascending; b is raw."""
    up, back = _powers()
    out = np.empty(len(start), np.uint64)
    size = stop - start
    cuts = np.searchsorted(start, np.arange(0, len(b) + STEP, STEP))
    total = np.zeros(min(len(b), STEP + SHORT) + 1, np.uint64)
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if lo < hi:
            base = k * STEP
            own = b[base : base + STEP + SHORT]
            np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=total[1 : len(own) + 1])
            a = start[lo:hi] - base
            z = np.minimum(stop[lo:hi] - base, len(own))
            out[lo:hi] = (total[z] - total[a]) * back[a] + size[lo:hi].astype(np.uint64)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[int(start[i]) : int(stop[i])])
    return out
