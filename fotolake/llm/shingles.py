"""Sets of five-word shingles as arrays of 64-bit hashes, for Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from fotolake.llm.hashes import part_hashes

SHINGLE, GROUP = 5, 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Of each text its distinct shingles, ascending.  Fewer than five words: the whole sequence as one; no word: none."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= GROUP:
            yield from _group(held)
            held, size = [], 0
    yield from _group(held)


def _group(held: list[bytes]) -> Iterator[np.ndarray]:
    raw = b"\n".join([*held, b""]).lower()
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return
    edge = np.flatnonzero(np.diff(_WORD[b].view(np.int8), prepend=np.int8(0)))
    start, stop = edge[::2], edge[1::2]  # the last character is white space
    h = part_hashes(raw, b, start, stop)
    terms = [mix(h * _FACTORS[j] + np.uint64(j)) for j in range(SHINGLE)]
    n = len(h)
    m = max(0, n - SHINGLE + 1)
    total = np.full(m, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        total += terms[j][j : m + j]
    total = mix(total)
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
    cut = np.searchsorted(start, np.r_[0, ends]).tolist()
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        k = z - a
        if k >= SHINGLE:
            s = np.sort(total[a : z - SHINGLE + 1])
            same = s[1:] == s[:-1]
            yield s[np.r_[True, ~same]] if same.any() else s
        elif k:
            yield mix(np.array([k], np.uint64) + sum((terms[j][a + j : a + j + 1] for j in range(k)), np.zeros(1, np.uint64)))
        else:
            yield np.empty(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def signature(s: np.ndarray) -> tuple[int, int]:
    """A digest of a set: signed integers of 64 and 32 bits."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:12], "little", signed=True)
