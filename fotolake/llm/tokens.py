"""Exact, fast use of tokenizer files on Python workers.

``Encoder`` gives each text the ids that the tokenizers library gives it.  Blocks of texts are split as arrays of character
classes; pre-tokens repeat, and what each becomes is kept in a table of fixed size.  ``Merger`` merges all new
pre-tokens of a block at once, as arrays.  For which characters the classes split as the library does is proven
beforehand, one by one, and so is that the merger gives the library's ids for every string of the vocabulary and for
pairs of such (``prove``).  Texts with other characters, long pre-tokens and other models go to the library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from fotolake.llm.common import own_caches, trim
from fotolake.llm.hashes import part_hashes

#: Characters that some Unicode tables call white space and others don't; no cut is made beside them.
_ODD = "\u180e\u200b\ufeff"
_CUT = re.compile(rf"(?<=[^\s{_ODD}]) (?=[^\s{_ODD}])")
BLOCK = 1 << 19
#: The splits, with letters, digits and white space as Python's re has them.
SPLITS = {
    "bytes": re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "words": re.compile(r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+"),
}
#: Runs of white space that the split of kind "bytes" may join, and white space that is neither space nor line feed.
_RUNS, _WHITE = ("  ", " \n", "\n ", "\n\n\n"), re.compile(r"[^\S \n]")
Proof = tuple[str, str, str, bool]
_PROOFS: dict[str, Proof] = {}


def read_vocabulary(path: str) -> str:
    """The tokenizer file as text, read on the driver; executors get the text and need no such path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def library(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def safe_blocks(text: str, size: int | None = None) -> Iterator[str]:
    """Parts of about ``size`` characters; later ones start with a single space between two words."""
    size = size or BLOCK
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def kind_of(spec: dict) -> str:
    """bytes: split by the library's byte-level pattern.  words: lower case, white space dropped.  other: unknown."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in spec.get("added_tokens", [])):
        return "other"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "bytes"
    parts = pre.get("pretokenizers") or [{}]
    split = parts[0]
    same = (split.get("pattern") or {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    plain = all(p.get("type") == "ByteLevel" and not p.get("use_regex", True) and not p.get("add_prefix_space") for p in parts[1:])
    if same and plain and split.get("behavior") == "Removed" and split.get("invert") and [n["type"] for n in (norm or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return "other"


def prove(vocabulary: str) -> Proof:
    """The vocabulary, its kind, a pattern of the characters that only the library may split, and whether Merger serves.

    In which neighbours a character joins tells its class, so three probes for each character are enough.
    """
    key = hashlib.md5(vocabulary.encode()).hexdigest()
    if key not in _PROOFS:
        spec, tok = json.loads(vocabulary), library(vocabulary)
        kind = kind_of(spec)
        odd = "(?s:.)"
        if kind != "other":
            bad = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not _as_library(tok, kind, chr(c))]
            odd = f"[{_runs(bad)}\ud800-\udfff\U00010000-\U0010ffff]"
        _PROOFS[key] = vocabulary, kind, odd, kind != "other" and _merges_as_library(tok, kind, spec, odd)
        del spec, tok
        trim()
    return _PROOFS[key]


def _as_library(tok, kind: str, c: str) -> bool:
    if kind == "words":
        if unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff" or c == "\u03a3":
            return False  # may join its neighbours, or lower-case by its place
        if tok.normalizer.normalize_str(c) != (" " if c.isspace() else c.lower()):
            return False
        c = " " if c.isspace() else c.lower()
    split = tok.pre_tokenizer.pre_tokenize_str
    return all([p[1] for p in split(x)] == [m.span() for m in SPLITS[kind].finditer(x)] for x in (f"a{c}a", f"1{c}1", f"!{c}!"))


def _merges_as_library(tok, kind: str, spec: dict, odd: str) -> bool:
    if not Merger.serves(spec):
        return False
    ids = sorted(tok.get_vocab(with_added_tokens=False).values())
    strings = {x.strip() if kind == "words" else x for x in tok.decode_batch([[i] for i in ids], skip_special_tokens=False)}
    strings = [x for x in strings if SPLITS[kind].findall(x) == [x] and x == (x.lower() if kind == "words" else x) and not re.search(odd, x)]
    strings += [x + y for x, y in zip(strings, reversed(strings), strict=True) if SPLITS[kind].findall(x + y) == [x + y]]
    flat, n = Merger(spec).merge([x.encode() for x in strings])
    want = [e.ids for e in tok.encode_batch_fast(strings, add_special_tokens=False)]
    long = n < 0
    have = np.split(flat, np.cumsum(np.where(long, 0, n))[:-1])
    return all(skip or a.tolist() == b for skip, a, b in zip(long, have, want, strict=True))


def _runs(codes: list[int]) -> str:
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def encoder(proof: Proof, whole: frozenset[str] | None = None) -> Encoder:
    """One encoder for each Python worker at a time; with ``whole`` it counts."""
    open_ = own_caches("tokens")
    key = hashlib.md5(proof[0].encode()).hexdigest(), whole is None
    if key not in open_:
        open_.clear()
        open_[key] = Encoder(proof, whole=whole)
    return open_[key]


def byte_characters() -> str:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return "".join(chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256))


class Merger:
    """Byte-pair merging of many pre-tokens at once.

    In each round every pre-token merges its pair of least rank, the leftmost of equal ones.  Rows are pre-tokens;
    what was merged away is cut out of a list of neighbours, and the stop column never merges.
    """

    NEVER, SHARED, BITS = np.int32(2**31 - 1), np.int32(-1), 19
    WIDTHS = (6, 9, 12, 16, 24, 32)

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.last = np.array([vocab[c + suffix] for c in byte_characters()], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # Most pairs have a slot of their own; in the others the sorted keys are searched.
        slot = self._slot(keys)
        alone = np.bincount(slot, minlength=1 << self.BITS)[slot] == 1
        self.slot_key = np.zeros(1 << self.BITS, np.uint32)
        self.slot_rank = np.full(1 << self.BITS, self.NEVER, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = keys, np.where(alone, np.arange(len(keys), dtype=np.int32), self.SHARED)
        self.start = [self._look(np.repeat(self.inner, 256), np.tile(right, 256)) for right in (self.inner, self.last)]

    @staticmethod
    def serves(spec: dict) -> bool:
        m = spec["model"]
        odd = any(m.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        suffix = m.get("end_of_word_suffix") or ""
        return m.get("type") == "BPE" and not odd and all(c in m["vocab"] and c + suffix in m["vocab"] for c in byte_characters()) and max(m["vocab"].values()) < 1 << 16

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NEVER for pairs that don't merge and beside a stop (-1)."""
        key = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) & np.uint32(0xFFFF))
        slot = self._slot(key)
        rank = self.slot_rank[slot]
        out = np.where(self.slot_key[slot] == key, rank, self.NEVER)
        shared = np.flatnonzero(rank == self.SHARED)
        if len(shared):
            at = np.minimum(np.searchsorted(self.keys, key.ravel()[shared]), len(self.keys) - 1)
            out.ravel()[shared] = np.where(self.keys[at] == key.ravel()[shared], self.ranks[at], self.NEVER)
        out[(a < 0) | (b < 0)] = self.NEVER
        return out

    def merge(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each item has; -1 (and no ids) for empty items and for those too long."""
        size = np.fromiter(map(len, items), np.int64, len(items))
        n = np.full(len(items), -1, np.int64)
        found = []
        for low, high in zip((0, *self.WIDTHS), self.WIDTHS, strict=False):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                sym = self._rows([items[i] for i in rows.tolist()], size[rows], high)
                there = sym >= 0
                n[rows] = there.sum(axis=1)
                found.append((rows, sym[there]))
        start = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
        flat = np.empty(int(np.maximum(n, 0).sum()), np.uint32)
        for rows, ids in found:
            k = n[rows]
            flat[np.repeat(start[rows] - np.cumsum(k) + k, k) + np.arange(len(ids))] = ids
        return flat, n

    def _rows(self, items: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(items), np.uint8).astype(np.int64)
        m = len(items)
        sym = np.full((m, width + 1), -1, np.int32)
        sym[np.arange(width + 1) < size[:, None]] = self.inner[flat]
        ends = np.cumsum(size) - 1
        sym[np.arange(m), size - 1] = self.last[flat[ends]]
        rank = np.full((m, width + 1), self.NEVER, np.int32)
        firsts = np.arange(width + 1) < size[:, None] - 1
        inside = np.ones(len(flat), bool)
        inside[ends] = False
        left = np.flatnonzero(inside)
        pair = flat[left] * 256 + flat[left + 1]
        closing = ~inside[left + 1]
        rank[firsts] = np.where(closing, self.start[1][pair], self.start[0][pair])
        after = np.tile(np.arange(1, width + 2, dtype=np.int8), (m, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int8), (m, 1))
        on = np.arange(m)
        while len(on):
            own = rank[on]
            p = own.argmin(axis=1)
            best = own[np.arange(len(on)), p]
            go = best != self.NEVER
            on, p, best = on[go], p[go], best[go]
            gone = after[on, p]
            then, prior, new = after[on, gone], before[on, p], self.made[best]
            sym[on, p], sym[on, gone], rank[on, gone] = new, -1, self.NEVER
            after[on, p], before[on, then] = then, p
            rank[on, p] = self._look(new, sym[on, then])
            rank[on, prior] = self._look(sym[on, prior], new)  # before the first stands the stop column
        return sym


class _Table:
    """From 64-bit hashes to places in a pool of ids, one entry a slot: a new entry drives out the old."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        self.n = np.zeros(1 << bits, np.int32)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        slot = self.slots(h)
        # Of several that meet in one slot, numpy need not write the same to each array.
        slot, own = np.unique(slot, return_index=True)
        self.keys[slot], self.at[slot], self.n[slot] = h[own], at[own], n[own]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, or their counts, of many texts at once.

    Texts are joined with a separator, and all pre-tokens of a block are found, hashed and looked up as arrays.  Those
    that are not known are merged, each distinct one once.  What is known is bounded: ``bits`` of a table, and a pool
    of some ids, which is emptied when full.  Strings of ``whole`` are one id alone and are never merged for a count.
    """

    POOL, SPARE = 6_000_000, 1 << 20

    def __init__(self, proof: Proof, bits: int = 20, whole: frozenset[str] | None = None):
        vocabulary, self.kind, odd, merges = proof
        spec = json.loads(vocabulary)
        self.tok, self.odd = library(vocabulary), re.compile(odd)
        self.ascii_odd = any(self.odd.match(chr(c)) for c in range(128))
        self.merger = Merger(spec) if merges else None
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.find = SPLITS.get(self.kind, SPLITS["bytes"]).finditer
        self.bits = bits
        self._forget()
        self.whole = None
        if whole:
            self.whole = _Table(20)
            h = self._hash_strings(sorted(whole))
            self.whole.put(h, np.zeros(len(h), np.int32), np.ones(len(h), np.int32))
        if self.kind != "other":
            self.classes = _classes()

    def _forget(self) -> None:
        self.table = _Table(self.bits)
        self.pool = np.empty(self.POOL + self.SPARE, np.uint32)
        self.used = 0

    def _hash_strings(self, strings: list[str]) -> np.ndarray:
        parts = [x.encode() for x in strings]
        stop = np.cumsum([len(x) for x in parts])
        raw = b"".join(parts)
        return part_hashes(raw, np.frombuffer(raw, np.uint8), np.r_[0, stop[:-1]], stop)

    def ask(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def must_ask(self, text: str) -> bool:
        return self.kind == "other" or "\0" in text or (self.ascii_odd or not text.isascii()) and bool(self.odd.search(text)) or any(a in text for a in self.added)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; a null text counts as empty."""
        for parts in self._worked(texts, True):
            yield b"".join([x.astype("<u4").tobytes() for x in parts])

    def count(self, texts: Iterable[str | None]) -> Iterator[int]:
        for parts in self._worked(texts, False):
            yield sum(int(x) for x in parts)

    def _worked(self, texts: Iterable[str | None], ids: bool) -> Iterator[list]:
        """For each text its ids or counts, in parts."""
        waiting: list[list | None] = []  # of each text the parts that are known; None stands for one to come
        blocks: list[str] = []
        size = 0

        def flush() -> Iterator[list]:
            got = iter(self._blocks(blocks, ids))
            for parts in waiting:
                yield [next(got) if x is None else x for x in parts]

        for text in texts:
            text = text or ""
            if self.must_ask(text):
                known = self.ask(text)
                waiting.append([known if ids else len(known)])
            else:
                own: list = []
                for block in safe_blocks(text.lower() if self.kind == "words" else text):
                    if len(block) > 2 * BLOCK:  # nowhere to cut
                        own.append(self.ask(block) if ids else len(self.ask(block)))
                        continue
                    own.append(None)
                    blocks.append(block)
                    size += len(block)
                waiting.append(own)
            if size >= BLOCK:
                yield from flush()
                waiting, blocks, size = [], [], 0
        yield from flush()

    def _blocks(self, blocks: list[str], ids: bool) -> list:
        """The ids of each block, or how many."""
        if not blocks:
            return []
        joined = "\0".join([*blocks, ""])
        point = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        length = np.fromiter(map(len, blocks), np.int64, len(blocks))
        begin = np.cumsum(length + 1) - length - 1
        kind = self.classes[point]
        first = self._starts(joined, point, kind, blocks, begin)
        start = np.flatnonzero(first)
        real = kind[start] < (_SPACE if self.kind == "words" else _END)
        stop = np.r_[start[1:], len(point)]
        raw = joined.encode()
        b = np.frombuffer(raw, np.uint8)
        if len(b) > len(point):
            place = np.zeros(len(point) + 1, np.int64)
            np.cumsum(1 + (point >= 0x80) + (point >= 0x800), out=place[1:])
            start, stop, begin = place[start], place[stop], place[begin]
        start, stop = start[real], stop[real]
        at, n = self._known(raw, b, start, stop, ids)
        cut = np.searchsorted(start, np.r_[begin, len(b)])
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        cut = total[cut]
        if not ids:
            return np.diff(cut).tolist()
        flat = self.pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        return [flat[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _starts(self, joined: str, point: np.ndarray, kind: np.ndarray, blocks: list[str], begin: np.ndarray) -> np.ndarray:
        """Where pre-tokens, single white space and separators begin."""
        prior = np.empty_like(kind)
        prior[0], prior[1:] = _END, kind[:-1]
        if self.kind == "words":
            first = (kind != prior) | (kind == _DIGIT)
        else:
            # A space belongs to what follows it.
            first = (kind >= _SPACE) | (kind != prior) & (prior != _SPACE)
        for i in np.flatnonzero((point == 39) & first).tolist():
            for tail in _TAILS:
                if joined.startswith(tail, i + 1):
                    first[i + 1 : i + 1 + len(tail)] = False
                    first[i + 1 + len(tail)] = True
                    break
        if self.kind == "bytes":
            for block, at in zip(blocks, begin.tolist(), strict=True):
                if any(x in block for x in _RUNS) or block.endswith("\n\n") or not block.isprintable() and _WHITE.search(block):
                    first[at : at + len(block)] = False
                    first[[at + m.start() for m in self.find(block)]] = True
        return first

    def _known(self, raw: bytes, b: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each pre-token where its ids begin in the pool, and how many there are."""
        if self.used > self.POOL:
            self._forget()
        h = part_hashes(raw, b, start, stop)
        at, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        rest = np.arange(len(h))
        for table in (self.whole, self.table) if self.whole and not ids else (self.table,):
            slot = table.slots(h[rest])
            hit = table.keys[slot] == h[rest]
            at[rest[hit]], n[rest[hit]] = table.at[slot[hit]], table.n[slot[hit]]
            rest = rest[~hit]
        if len(rest):
            new, own, back = np.unique(h[rest], return_index=True, return_inverse=True)
            pieces = [raw[a:z] for a, z in zip(start[rest[own]].tolist(), stop[rest[own]].tolist(), strict=True)]
            flat, k = self._merged(pieces)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(len(flat) + self.SPARE, np.uint32)])
            self.pool[self.used : self.used + len(flat)] = flat
            place = self.used + np.cumsum(k) - k
            self.used += len(flat)
            at[rest], n[rest] = place[back], k[back]
            self.table.put(new, place, k)
        return at, n

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.merger is None:
            found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        flat, n = self.merger.merge(pieces)
        long = np.flatnonzero(n < 0)
        if len(long):
            asked = {i: self.ask(pieces[i].decode()) for i in long.tolist()}
            parts = np.split(flat, np.cumsum(np.maximum(n, 0))[:-1])
            flat = np.concatenate([asked.get(i, x) for i, x in enumerate(parts)])
            n[long] = [len(asked[i]) for i in long.tolist()]
        return flat, n


#: Classes of characters: letters, digits, others, a space, other white space, and the separator of texts.
_LETTER, _DIGIT, _OTHER, _SPACE, _WHITE_SPACE, _END = range(6)
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """The class of each character of the basic plane, as Python's patterns have it."""
    letter, digit = re.compile(r"[^\W\d_]").match, re.compile(r"\d").match
    out = [_LETTER if letter(c) else _DIGIT if digit(c) else _WHITE_SPACE if c.isspace() else _OTHER for c in map(chr, range(0x10000))]
    out[32], out[0] = _SPACE, _END
    return np.array(out, np.uint8)
