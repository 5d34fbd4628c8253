"""Token-id files: a wavelet matrix for each shard.

A shard file is one compressed image: header, documents' ids and lengths, then one bit plane for each bit
of a token id (most significant first), then for each plane the number of ones in every 512 bits.  In each plane the
tokens stand in the order that the planes above gave them (zeros first, stably).  Planes and counts are packed one by one
and answer rank and select, hence access(i), count(token) and locate(token); tokens are not decoded for
it, and a search ends at the first plane that rules its token out.

Shards are written through Spark as rows of a binary table, so that any store Spark writes to will do and its
commit protocol drops what lost or repeated tasks wrote; ``export`` puts images into plain files.
Documents are in ascending doc_id order over the shards (range partitions, sorted within); rows of one id, or without one,
are ordered by a hash of their text, so that many of them fill many partitions.

Defined cases: a null text is empty and still has its end id; null ids come first; repeated rows are
written each; very long texts are encoded in blocks and make a shard of their own size; no documents
give no shards; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import pick, scratch_path, shuffle_partitions
from fotolake.llm.tokens import encoder, prove, read_vocabulary

END_ID, SHARD_TOKENS = 2, 1 << 20
MAGIC = b"WMTX0002"
WORD = 512  # bits between two stored counts
FILES = "part int, seq int, first long, n_tokens long, n_docs long, image binary"


class WaveletMatrix:
    """Tokens as bit planes with counts of ones before each block of WORD bits.

    ``plane`` and ``counts`` give those of one level; a matrix read from a file unpacks them when they are asked for.
    """

    def __init__(self, n: int, bits: int, zeros: list[int], plane: Callable[[int], np.ndarray], counts: Callable[[int], np.ndarray]):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.plane, self.counts = functools.cache(plane), functools.cache(counts)

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(tokens.max(initial=0)).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.ascontiguousarray(tokens, kind)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            ones = now & kind(1 << b) != 0
            planes.append(np.packbits(ones))
            low, high = np.compress(~ones, now), np.compress(ones, now)
            zeros.append(len(low))
            now = np.concatenate([low, high])
        n = len(now)
        return cls(n, bits, zeros, planes.__getitem__, lambda k: _ones_before(planes[k], n))

    def tokens(self) -> np.ndarray:
        """All tokens in order, plane by plane from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.plane(k), count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = value[: self.zeros[k]]
            out[np.flatnonzero(ones)] = value[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            value = out
        return value.astype(np.uint32)

    def _ones(self, k: int, i: int) -> int:
        """Ones in plane k before place i."""
        block, rest = divmod(i, WORD)
        at = block * (WORD // 8)
        return int(self.counts(k)[block]) + int(np.unpackbits(self.plane(k)[at : at + -(-rest // 8)])[:rest].sum())

    def _bit(self, k: int, i: int) -> int:
        return int(self.plane(k)[i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            if lo == hi:  # no such token: deeper planes stay packed
                break
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Times that token stands before place i."""
        lo, hi = self._range(token, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of token."""
        lo, hi = self._range(token, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in range(self.bits - 1, -1, -1):
            i = self._select_bit(k, token >> (self.bits - 1 - k) & 1, i - self.zeros[k] if i >= self.zeros[k] else i)
        return i

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        counts = self.counts(k)
        have = counts if bit else np.minimum(np.arange(len(counts)) * WORD, self.n) - counts
        block = int(np.searchsorted(have, nth, side="right")) - 1
        at = block * (WORD // 8)
        bits = np.unpackbits(self.plane(k)[at : at + WORD // 8], count=min(WORD, self.n - block * WORD))
        return block * WORD + int(np.flatnonzero(bits == bit)[nth - int(have[block])])

    def locate(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]


def _ones_before(plane: np.ndarray, n: int) -> np.ndarray:
    """How many ones stand before each block of WORD bits, and in all."""
    whole = np.zeros(-(-max(n, 1) // WORD) * (WORD // 8), np.uint8)
    whole[: len(plane)] = plane
    return np.concatenate([[0], np.cumsum(np.bitwise_count(whole).reshape(-1, WORD // 8).sum(axis=1, dtype=np.int64))])


def write_image(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    wm = WaveletMatrix.build(tokens)
    small = zstandard.ZstdCompressor(level=1).compress
    parts = [
        np.array([x or 0 for x in ids], "<i8"), np.packbits([x is not None for x in ids]), np.array(lengths, "<i8"),
        *[wm.plane(k) for k in range(wm.bits)],
        *[np.diff(wm.counts(k)).astype("<u2") for k in range(wm.bits)],
    ]
    parts = [small(x.tobytes()) for x in parts]
    head = json.dumps({"n": wm.n, "docs": len(ids), "bits": wm.bits, "zeros": wm.zeros, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Ids, lengths and the matrix; planes and counts are unpacked one by one, when they are first asked for."""
    if image[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    (n,) = struct.unpack_from("<I", image, 8)
    head = json.loads(image[12 : 12 + n])
    stop = np.cumsum(head["sizes"]) + 12 + n

    def part(i: int, kind: str) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(image[int(stop[i]) - head["sizes"][i] : int(stop[i])]), kind)

    there = np.unpackbits(part(1, "u1"), count=head["docs"])
    ids = [int(x) if ok else None for x, ok in zip(part(0, "<i8"), there, strict=True)]
    wm = WaveletMatrix(
        head["n"], head["bits"], head["zeros"], lambda k: part(3 + k, "u1"),
        lambda k: np.concatenate([[0], np.cumsum(part(3 + head["bits"] + k, "<u2"), dtype=np.int64)]),
    )
    return ids, part(2, "<i8"), wm


def write_token_files(docs: DataFrame, vocabulary_path: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every document, append the end id, and write shards of about ``shard_tokens`` tokens to path."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(prove(read_vocabulary(vocabulary_path)))
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, first = encoder(sent.value), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        lengths: list[int] = []
        body: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            image = write_image(ids, lengths, np.frombuffer(b"".join(body), "<u4"))
            row = [[part], [seq], [first], [size], [len(ids)], [image]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in FILES.split(", ")])

        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), enc.encode(t.as_py() for t in b.column(1)), strict=True):
                ids.append(doc)
                lengths.append(len(got) // 4 + 1)
                body += [got, end]
                size += lengths[-1]
                if size >= shard_tokens:
                    yield shard()
                    seq, first = seq + 1, first + size
                    ids, lengths, body, size = [], [], [], 0
        if ids:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    base = pick(docs, "doc_id", "text")
    ordered = base.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(work, FILES).write.parquet(path)


def read_token_files(docs_path: str, like: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shard files."""
    files = like.sparkSession.read.schema(FILES).parquet(docs_path)
    # As many rows as range partitions wrote; their sums in order place each partition.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, image in zip(*(b.column(i) for i in range(3)), strict=True):
                ids, lengths, wm = read_image(image.as_py())
                tokens = wm.tokens().astype("<u4")
                stop = np.cumsum(lengths)
                crc = [zlib.crc32(tokens[a:z]) for a, z in zip(stop - lengths, stop, strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(first.as_py() + stop - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "first", "image").mapInArrow(work, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary_path: str, path: str | None = None) -> DataFrame:
    """Write the files and read them back.  Without a path they are scratch files."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, vocabulary_path, path)
    return read_token_files(path, docs)


def export(path: str, like: DataFrame, folder: str) -> int:
    """Copy shard images into plain files of a local folder, one at a time; returns their number."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in like.sparkSession.read.schema(FILES).parquet(path).toLocalIterator():
        with open(os.path.join(folder, f"{r.part:06d}-{r.seq:06d}.wm"), "wb") as f:
            f.write(r.image)
        n += 1
    return n
