"""Exact Jaccard self-join (0.75) of five-word shingle sets, by set relations.

1. Texts become sets of shingle hashes; equal sets are one class, named by 96 bits of a digest and the size.
2. A sketch of fixed size counts all shingles.  It orders shingles, rare ones first; a wrong count costs time
   but no result, since any one order does.
3. Each set puts its prefix (the n - ceil(3n/4) + 1 first shingles) into an index, each with its
   position.  Index lists are dealt by shingle, into buckets whose number follows the number of postings, and
   deduplicated before they are sent.  Lists that the sketch calls hot are dealt by set instead, over all buckets.
4. Index-level skipping: a set stays in a list only where another set of that list could still link with it,
   by their sizes and by the shingles that remain after the shared one.  (In hot lists all sets stay.)
5. The sets that stay are gathered by the head of their lists, over all its lists, in tiles of bounded size.  Within a
   tile a set's answers for all others are derived from those of the most similar set answered before:
   only the shingles in which the two differ are looked up.  A pair that meets under several heads is
   answered under the least of them, so each link between distinct sets is counted once.
Components and the number of links of each set are exact.  Copies are one set and are not expanded, and links
are counted within tiles, so what is stored grows with the members of tiles; the time within a large
group of near copies grows with the square of the group.

Defined cases: texts without words have an empty set and link with nothing; very long texts are sets like others, and a
tile holds one at least; rows with one id are one node, which has the links of all its texts, but each row has the
number of links of its own text; rows with a null id link with nothing and have a null component and no links;
repeated rows are returned each; no documents give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import drop_scratch, materialize, own_caches, pick, shuffle_partitions
from fotolake.llm.components import connected_components
from fotolake.llm.shingles import shingle_sets, signature

WIDTH_BITS, PARTS = 22, 64
#: Postings of a bucket, postings that a task holds back, and how often a shingle occurs that is hot at least.
BUCKET, HELD, HOT = 400_000, 500_000, 100_000
#: Shingles of half a tile, postings met at once, and answers that a tile keeps to derive others from.
TILE, POSTINGS_AT_ONCE, LEADERS = 1_000_000, 500_000, 24
KEY = ["sig", "tag", "n"]
#: Of a shingle's 64 bits the high ones choose the bucket; lists that its low 32 bits tell apart no more only merge.
POSTING = np.dtype([("s", "<u4"), ("sig", "<i8"), ("tag", "<i4"), ("n", "<i4"), ("pos", "<i4")])
SETS = "doc_id long, sig long, tag int, n int, part int, counts binary"


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _counted(counts: np.ndarray, held: list[np.ndarray]) -> None:
    at = np.concatenate(held) >> np.uint64(64 - WIDTH_BITS)
    at, n = np.unique(at.astype(np.int64), return_counts=True)
    counts[at] += n.astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, sig, tag, n of each text, and after them the task's shares of the sketch."""
    own_caches("shingles")
    counts = np.zeros(1 << WIDTH_BITS, np.uint32)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for b in batches:
        sizes, sigs, held, waiting = [], [], [], 0
        for s in shingle_sets(t.as_py() for t in b.column(1)):
            sizes.append(len(s))
            sigs.append(signature(s))
            held.append(s)
            waiting += len(s)
            if waiting > 1 << 19:
                _counted(counts, held)
                held, waiting = [], 0
        if held:
            _counted(counts, held)
        none = [None] * b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([x[0] for x in sigs], kinds[1]), pa.array([x[1] for x in sigs], kinds[2]), pa.array(sizes, kinds[3]), pa.array(none, kinds[4]), pa.array(none, kinds[5])],
            _columns(SETS),
        )
    if counts.any():
        shares = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, PARTS)]
        none = [None] * PARTS
        yield pa.RecordBatch.from_arrays([*(pa.array(none, k) for k in kinds[:4]), pa.array(range(PARTS), kinds[4]), pa.array(shares, kinds[5])], _columns(SETS))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the sketch, summed as they stream by."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            now = np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.uint64)
            total[part] = total[part] + now if part in total else now
    if total:
        rank = [np.minimum(np.log2(x + 1.0) * 6, 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rank, pa.binary())], ["part", "rank"])


def set_order(rows: DataFrame) -> bytes:
    """A rank for each of 2 ** WIDTH_BITS hash ranges: 4 MB in all, whatever the input."""
    shares = rows.where("part is not null").select("part", "counts").repartition(PARTS, "part")
    got = {r.part: bytes(r["rank"]) for r in shares.mapInArrow(_summed, "part int, rank binary").collect()}
    return b"".join(got[k] for k in sorted(got)) or bytes(1 << WIDTH_BITS)


def hot_rank(order: bytes) -> int:
    """The rank from which shingles are hot: HOT, and eight times as often as the mean of the ranges."""
    mean = float(np.exp2(np.frombuffer(order, np.uint8) / 6.0).mean())
    return int(np.log2(max(HOT, 8 * mean) + 1) * 6)


def _index(order, hot: int, buckets: int):
    """Postings, as one binary value for each bucket and flush of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("shingles")
        rank = np.frombuffer(order.value, np.uint8)
        held: list[np.ndarray] = []
        places: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every, at = np.concatenate(held), np.concatenate(places)
            order_ = np.argsort(at, kind="stable")
            every, at = every[order_], at[order_]
            cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            raw = every.tobytes()
            blobs = [raw[POSTING.itemsize * a : POSTING.itemsize * z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            of = at[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(of % buckets, pa.int32()), pa.array(of >= buckets), pa.array(blobs, pa.binary())], ["bucket", "hot", "postings"])

        seen: set[int] = set()  # copies within a task are sent once, as far as this set goes; _lists drops the others
        for b in batches:
            for s in shingle_sets(t.as_py() for t in b.column(0)):
                n = len(s)
                if not n:
                    continue
                sig, tag = signature(s)
                if sig in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(sig)
                k = n - (3 * n + 3) // 4 + 1
                often = rank[s >> np.uint64(64 - WIDTH_BITS)]
                # Shingles are ascending, so a stable sort by rank orders equal ranks by hash.
                first = np.argsort(often, kind="stable")[:k]
                x = s[first]
                own = np.empty(k, POSTING)
                own["s"], own["sig"], own["tag"], own["n"], own["pos"] = x & np.uint64(0xFFFFFFFF), sig, tag, n, np.arange(k)
                held.append(own)
                by_set = buckets + sig % buckets
                places.append(np.where(often[first] >= hot, by_set, ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)))
                size += k
                if size > HELD:
                    yield from flush()
                    held, places, size = [], [], 0
        if held:
            yield from flush()

    return work


def _reach(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """The largest value of each range lo..hi (hi left out), by a table of maxima over powers of two."""
    size = np.maximum(hi - lo, 0)
    out = np.full(len(lo), np.iinfo(np.int64).min)
    level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
    for k in np.unique(level[size > 0]):
        while len(table) <= k:
            last, half = table[-1], 1 << (len(table) - 1)
            table.append(np.maximum(last[:-half], last[half:]))
        at = np.flatnonzero((size > 0) & (level == k))
        out[at] = np.maximum(table[k][lo[at]], table[k][hi[at] - (1 << k)])
    return out


def may_link(s: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whether each posting could link with another of its list.  Postings come sorted by s and n.

    a and b can where 4 * min(n) >= 3 * max(n) and 7 * min(rest) >= 3 * (n of a + n of b).
    """
    if not len(s):
        return np.zeros(0, bool)
    spare = 7 * rest - 3 * n
    width = int(n.max()) + 2
    base = np.cumsum(np.r_[False, s[1:] != s[:-1]]) * width
    key, i = base + n, np.arange(len(s))
    lo = np.searchsorted(key, base + (3 * n + 3) // 4, "left")
    hi = np.searchsorted(key, base + np.clip(np.minimum(4 * n // 3, spare // 3), 0, width - 1), "right")
    table = [spare]
    best = np.maximum(_reach(spare, lo, np.minimum(i, hi), table), _reach(spare, np.maximum(i + 1, lo), hi, table))
    return best >= 3 * n


LISTED = "sig long, tag int, n int, head long, s long"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that may link, with the head (a signature) of each list that says so.  Of hot lists: all sets and the shingle."""
    blobs: list[list[bytes]] = [[], []]
    for b in batches:
        for hot, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            blobs[hot].append(x.as_py())
    for hot in (False, True):
        p = np.frombuffer(b"".join(blobs[hot]), POSTING)
        blobs[hot].clear()
        if not len(p):
            continue
        p = p[np.lexsort((p["tag"], p["sig"], p["n"], p["s"]))]
        same = p["s"][1:] == p["s"][:-1]
        p = p[np.r_[True, ~same | (p["sig"][1:] != p["sig"][:-1]) | (p["tag"][1:] != p["tag"][:-1]) | (p["n"][1:] != p["n"][:-1])]]
        if not hot:
            same = p["s"][1:] == p["s"][:-1]
            p = p[np.r_[False, same] | np.r_[same, False]]
            n = p["n"].astype(np.int64)
            p = p[may_link(p["s"], n, n - p["pos"])]
        cut = np.flatnonzero(np.r_[True, p["s"][1:] != p["s"][:-1]][: len(p)])
        head = np.repeat(p["sig"][cut], np.diff(np.r_[cut, len(p)]))
        rows = np.stack([p["sig"], p["tag"].astype(np.int64), p["n"].astype(np.int64), p["s"].astype(np.int64) if hot else head], axis=1)
        rows = np.unique(rows, axis=0)
        for at in range(0, len(rows), 100_000):
            x = rows[at : at + 100_000]
            last = pa.array(x[:, 3]), pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2].astype(np.int32)), *(last[::-1] if hot else last)], _columns(LISTED))


def headed(listed: DataFrame) -> DataFrame:
    """sig, tag, n, head, distinct.  Members of a hot list, which came from many tasks, get the least of all as head."""
    hot = listed.where("s is not null")
    least = hot.groupBy("s").agg(F.min(F.struct("n", "sig")).alias("x")).select("s", F.col("x.sig").alias("least"))
    named = hot.drop("head").join(least, "s").select(*KEY, F.col("least").alias("head"))
    return listed.where("s is null").select(*KEY, "head").unionByName(named).distinct()


ANSWERS = "sig long, tag int, n int, links long, a long, b long, common long"


class _Tile:
    """The distinct sets of a tile and an index of their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        self.kept: dict[int, np.ndarray] = {}

    def met(self, s: np.ndarray) -> np.ndarray:
        """How many of the shingles s each set has."""
        out = np.zeros(len(self.sets), np.int64)
        lo, hi = np.searchsorted(self.every, s, "left"), np.searchsorted(self.every, s, "right")
        part = np.cumsum(hi - lo) // POSTINGS_AT_ONCE
        for k in np.unique(part):
            own = part == k
            first, width = lo[own], (hi - lo)[own]
            at = np.repeat(first - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            out += np.bincount(self.owner[at], minlength=len(out))
        return out

    def common(self, i: int) -> np.ndarray:
        """How many shingles each set shares with set i, derived from the answers of the most similar set that are kept."""
        own = self.sets[i]
        best = max(self.kept, key=lambda j: int(self.kept[j][i]) - len(self.sets[j]) // 2, default=None)
        if best is None or (unlike := len(self.sets[best]) + len(own) - 2 * int(self.kept[best][i])) >= len(own):
            answers = self.met(own)
        elif unlike:
            answers = self.kept[best] - self.met(np.setdiff1d(self.sets[best], own, True)) + self.met(np.setdiff1d(own, self.sets[best], True))
        else:
            answers = self.kept[best]
        if best is None or 8 * unlike >= len(own):  # no answers kept are near enough: these serve the next
            self.kept[i] = answers
            if len(self.kept) > LEADERS:
                del self.kept[next(iter(self.kept))]
        return answers


def _answers(each: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among the sets of each tile.  Rows come sorted by head, i, j and chunk.

    ``each`` gives every link.  Otherwise each set's number of links comes (links), and links that tie what all links tie.
    """
    kinds = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in ANSWERS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _columns(ANSWERS))

    def work(tile: tuple, kept: list[tuple], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """kept: chunk, key, id, lesser heads of each set."""
        _, first, second = tile
        m = len(sets)
        if m < 2:
            return
        t = _Tile(sets)
        ids = [r[2] for r in kept]
        # Pairs that also meet under a lesser head are answered there.
        under: dict[int, list[int]] = {}
        for i, r in enumerate(kept):
            for h in r[3]:
                under.setdefault(h, []).append(i)
        lesser = {h: np.array(x) for h, x in under.items()}
        asked = m if first == second else sum(r[0] == first for r in kept)
        total = np.zeros(m, np.int64)
        label = np.arange(m)
        out: list[tuple] = []
        for i in range(asked):
            common = t.common(i)
            holds = (common > 0) & (7 * common >= 3 * (t.n + t.n[i]))
            holds[: i + 1 if first == second else asked] = False
            for h in kept[i][3]:
                holds[lesser[h]] = False
            others = np.flatnonzero(holds)
            total[i] += len(others)
            total[others] += 1
            if not each:
                others = others[np.unique(label[others], return_index=True)[1]]
                others = others[label[others] != label[i]]
            for j in others.tolist():
                if not each:
                    label[label == label[j]] = label[i]
                out.append((None, None, None, None, max(ids[i], ids[j]), min(ids[i], ids[j]), int(common[j])))
            if len(out) > 50_000:
                yield batch(out)
                out = []
        if not each:
            out += [(*r[1], c, None, None, None) for r, c in zip(kept, total.tolist(), strict=True) if c]
        if out:
            yield batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("shingles")
        now, kept, sets = None, [], []
        for b in batches:
            at = 0
            rows = list(zip(*(b.column(k).to_pylist() for k in range(9)), strict=True))
            for s in shingle_sets(t.as_py() for t in b.column(9)):
                head, i, j, chunk, *key, id_, lesser = rows[at]
                at += 1
                if (head, i, j) != now:
                    if sets:
                        yield from work(now, kept, sets)
                    now, kept, sets = (head, i, j), [], []
                key = tuple(key)
                # Not another text of that id, nor the same once more (rows come sorted).
                if not (kept and kept[-1][1] == key) and len(s) == key[2] and signature(s) == key[:2]:
                    kept.append((chunk, key, id_, lesser))
                    sets.append(s)
        if sets:
            yield from work(now, kept, sets)

    return run


def known_ids(ids: DataFrame, bits: int = 25) -> DataFrame:
    """slot, bitmap: which of 2 ** bits hashes of ids there are; 4 MB at most, whatever the input."""
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("h")).selectExpr("h div 32768 as slot", "h % 32768 as at")
    return at.groupBy("slot").agg(F.expr("bitmap_construct_agg(at)").alias("bitmap"))


def tiles(gathered: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of each tile, in order.  gathered: sig, tag, n, head, distinct; docs: doc_id, text.

    The members of a head are dealt into chunks of about TILE shingles; each pair of chunks is a tile, worked on by itself.
    """
    chunks = gathered.groupBy("head").agg(F.sum("n").alias("m")).select("head", F.expr(f"cast((m - 1) div {TILE} + 1 as int)").alias("chunks"))
    chunks = chunks.where("chunks > 1")  # few: each stands for many members
    dealt = gathered.join(chunks, "head", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    place = F.struct("head", "chunks", F.pmod(F.xxhash64(*KEY), F.col("chunks")).cast("int").alias("chunk"))
    placed = dealt.groupBy(*KEY).agg(F.collect_list(place).alias("at")).join(classes, KEY)
    # A bitmap of fixed size keeps most other documents from the shuffle; the join itself is by id.
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 25))
    some = F.broadcast(known_ids(placed.select("id")))
    hashed = docs.where("doc_id is not null").withColumn("_h", bit).withColumn("_slot", F.expr("_h div 32768"))
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(_h % 32768 div 8 + 1 as int), 1)), 16, 10) as int)")
    there = F.expr("cast(_h % 8 as int)")
    asked = hashed.join(some, F.col("_slot") == F.col("slot")).withColumn("_byte", byte).withColumn("_bit", there).where("shiftright(_byte, _bit) & 1 = 1").select("doc_id", "text")
    met = asked.join(placed, asked["doc_id"] == placed["id"]).select(*KEY, "id", "text", "at", F.explode("at").alias("x"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, x.chunks - 1)")))
    lesser = F.expr("transform(filter(at, y -> y.head < x.head), y -> y.head)")
    rows = met.select(
        F.col("x.head").alias("head"), F.least("x.chunk", "other").alias("i"), F.greatest("x.chunk", "other").alias("j"),
        F.col("x.chunk").alias("chunk"), *KEY, "id", lesser.alias("lesser"), "text",
    )
    return rows.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "chunk", *KEY)


def _linked(docs: DataFrame, pairs: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Per row doc_id, n_shingles, component_id, n_links; and, if asked for, every link."""
    spark = docs.sparkSession
    base = pick(docs, "doc_id", "text")
    rows = materialize(base.mapInArrow(_sets, SETS), "sets")
    ranks = set_order(rows)
    order = spark.sparkContext.broadcast(ranks)
    signed = rows.where("part is null").select("doc_id", *KEY)
    named = signed.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy(*KEY).agg(F.min("doc_id").alias("id")), "classes")

    postings = classes.agg(F.sum(F.expr("n - (3L * n + 3) div 4 + 1"))).first()[0] or 0
    buckets = int(max(64, shuffle_partitions(spark), postings // BUCKET))
    index = base.where("doc_id is not null").select("text").mapInArrow(_index(order, hot_rank(ranks), buckets), "bucket int, hot boolean, postings binary")
    listed = materialize(index.repartitionById(buckets, "bucket").mapInArrow(_lists, LISTED), "listed")
    gathered = materialize(headed(listed), "gathered")
    drop_scratch(listed)
    tiled = tiles(gathered, classes, base)
    links = materialize(tiled.mapInArrow(_answers(True), ANSWERS).select("a", "b", "common"), "links") if pairs else None
    found = materialize(tiled.mapInArrow(_answers(False), ANSWERS), "found")
    drop_scratch(gathered)
    # An id with several texts ties their classes together.
    mine = named.join(classes, KEY).groupBy("doc_id").agg(F.min("id").alias("lo"), F.collect_set("id").alias("ids"))
    twice = mine.where("size(ids) > 1").select(F.explode("ids").alias("a"), F.col("lo").alias("b")).where("a <> b")
    roots = connected_components(found.where("a is not null").select("a", "b").unionByName(twice))
    counts = found.where("links is not null").groupBy(*KEY).agg(F.sum("links").alias("links"))
    told = classes.join(roots, F.col("id") == F.col("node"), "left").join(counts, KEY, "left")
    told = materialize(told.select(*KEY, F.coalesce("root", "id").alias("component_id"), "links"), "told")
    for done in (found, roots, classes):
        drop_scratch(done)
    # Ids whose texts are in different classes have been tied, so any class of an id gives its component.
    there = F.col("doc_id").isNotNull()
    out = signed.join(told, KEY, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(there, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(there, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return out, links


def jaccard_report(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_shingles, component_id and n_links, the number of other distinct sets its set links with."""
    return _linked(docs)[0]


def jaccard_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n_shingles, component_id; and every link between distinct sets (a, b, common), by the least id
    of each; a = b where two texts of one id link."""
    out, links = _linked(docs, True)
    return out.drop("n_links"), links


def jaccard_join(docs: DataFrame) -> DataFrame:
    return _linked(docs)[0].drop("n_links")
